"""Match operators: phrase/word spans, word distance, boolean truth per fragment,
minimal covers with their density.

Input is a frame of position lists ``(lexeme, file_id, sequence_no, positions)``
holding only the query's lexemes (an index lookup): a row per lexeme and fragment. It is
hash-partitioned once on ``(file_id, sequence_no)``, and phrases are intersections of
shifted lists inside a fragment's row (``list_spans``); whole books, whose lists span
fragments, take a row per occurrence (``chain_spans``). Either way every later aggregate, window and semi-join keys on
a superset of that, so the whole match stage runs without another shuffle and
no group is larger than one fragment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.query import And, Chain, Follow, Not, Or, Query, truth_when_absent

KEYS = ["file_id", "sequence_no"]
SPAN_COLS = ["file_id", "sequence_no", "s", "e"]

# Fixed value: covers of this many tokens or fewer get density 1.0.
DENSITY_TOKENS = 16


def chain_spans(hits: DataFrame, q: Query, partitioned: bool = False) -> DataFrame:
    """Spans ``(file_id, sequence_no, cid, s, e)`` of every chain of the query.

    Each hit is moved to its chain anchor (``pos - offset``); an anchor is a match
    when all terms of the chain arrived there. Repeated words in a phrase are
    distinct offsets, so ``count == terms`` is exact.
    """
    entries: dict[str, list] = {}
    for cid, ch in enumerate(q.chains):
        for off, lx in ch.terms:
            entries.setdefault(lx, []).append((cid, off, len(ch.terms), ch.last))
    from quire.operators.headline import sql_str

    pairs = []
    for lx in sorted(entries):
        items = ", ".join(
            f"named_struct('cid', {c}, 'off', {o}, 'n', {n}, 'last', {l})" for c, o, n, l in entries[lx]
        )
        pairs.append(f"{sql_str(lx)}, array({items})")
    lookup = F.expr("map(" + ", ".join(pairs) + ")")  # one literal map: lexeme -> its (chain, offset) slots
    x = hits.select(*KEYS, "pos", F.explode(F.element_at(lookup, F.col("lexeme"))).alias("t")).select(
        *KEYS,
        F.col("t.cid").alias("cid"),
        (F.col("pos") - F.col("t.off")).alias("s"),
        F.col("t.n").alias("n"),
        F.col("t.last").alias("last"),
    )
    if not partitioned:  # hits of a bucketed index already sit with their book
        x = x.repartition(*KEYS)
    g = x.groupBy(*KEYS, "cid", "s").agg(
        F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("last").alias("last")
    )
    return g.filter(F.col("c") == F.col("n")).select(*KEYS, "cid", "s", (F.col("s") + F.col("last")).alias("e"))


def list_spans(lists: DataFrame, q: Query, partitioned: bool = False) -> DataFrame:
    """Spans ``(file_id, sequence_no, cid, s, e)`` of every chain of the query, from
    position lists: a fragment's lists meet in one row, and a phrase's anchors are the
    positions common to its words' lists, each moved back by the word's offset."""
    if not partitioned:  # lists of a bucketed index already sit with their book
        lists = lists.repartition(*KEYS)
    # rows of one book id may come twice: their lists are one, grouped where they already are
    places = F.array_sort(F.flatten(F.collect_list("positions")))
    lists = lists.groupBy(*KEYS, "lexeme").agg(places.alias("positions"))
    x = lists.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("_m"))

    def moved(lexeme: str, off: int) -> Column:
        places = F.element_at("_m", F.lit(lexeme))
        return F.transform(places, lambda p: p - off) if off else places

    def spans(cid: int, chain: Chain) -> Column:
        anchors = reduce(F.array_intersect, [moved(lx, off) for off, lx in chain.terms])  # null when a word is missing
        return F.transform(anchors, lambda a: F.struct(F.lit(cid).alias("cid"), a.alias("s"), (a + chain.last).alias("e")))

    none = F.array().cast("array<struct<cid:int,s:int,e:int>>")
    found = F.concat(*[F.coalesce(spans(cid, ch), none) for cid, ch in enumerate(q.chains)])
    x = x.select(*KEYS, F.explode_outer(found).alias("_s")).filter(F.col("_s").isNotNull())
    return x.select(*KEYS, "_s.cid", "_s.s", "_s.e")


def _node_spans(node, cs: DataFrame, q: Query) -> DataFrame:
    """Spans ``(file_id, sequence_no, s, e)`` of a positive node."""
    if isinstance(node, Chain):
        return cs.filter(F.col("cid") == q.chain_id(node)).select(*SPAN_COLS)
    if isinstance(node, Or):
        return reduce(DataFrame.unionByName, [_node_spans(p, cs, q) for p in node.parts]).distinct()
    if isinstance(node, And):
        spans = [_node_spans(p, cs, q) for p in node.parts]
        both = reduce(lambda a, b: a.join(b, KEYS, "left_semi"), [s.select(*KEYS) for s in spans])
        return reduce(DataFrame.unionByName, spans).distinct().join(both.distinct(), KEYS, "left_semi")
    if isinstance(node, Follow):
        n = node.distance
        if isinstance(node.right, Not):
            a = _node_spans(node.left, cs, q).withColumn("k", F.col("e") + n)
            b = _node_spans(node.right.part, cs, q).select(*KEYS, F.col("s").alias("k"))
            return a.join(b, [*KEYS, "k"], "left_anti").select(*SPAN_COLS)
        if isinstance(node.left, Not):
            b = _node_spans(node.right, cs, q).withColumn("k", F.col("s"))
            a = _node_spans(node.left.part, cs, q).select(*KEYS, (F.col("e") + n).alias("k"))
            return b.join(a, [*KEYS, "k"], "left_anti").select(*SPAN_COLS)
        a = _node_spans(node.left, cs, q).select(*KEYS, "s", (F.col("e") + n).alias("k"))
        b = _node_spans(node.right, cs, q).select(*KEYS, F.col("s").alias("k"), "e")
        out = a.join(b, [*KEYS, "k"]).select(*SPAN_COLS)
        # spans of one chain have one length, so only wider operands can meet twice
        return out if isinstance(node.left, Chain) and isinstance(node.right, Chain) else out.distinct()
    raise ValueError(f"no span meaning for {node!r}")


def atom_spans(hits: DataFrame, q: Query, partitioned: bool = False) -> DataFrame:
    """Spans ``(file_id, sequence_no, atom, s, e)`` of the boolean-level atoms, from
    position lists or from occurrences.

    ``partitioned``: the hits are already hash-partitioned by ``file_id``."""
    chained = list_spans if "positions" in hits.columns else chain_spans
    cs = chained(hits, q, partitioned)
    parts = []
    chain_atoms = [(q.atom_id(a), q.chain_id(a)) for a in q.atoms if isinstance(a, Chain)]
    if chain_atoms:
        amap = F.create_map(*[F.lit(v) for pair in chain_atoms for v in (pair[1], pair[0])])
        parts.append(
            cs.filter(F.col("cid").isin([c for _, c in chain_atoms])).select(
                *KEYS, F.element_at(amap, F.col("cid")).alias("atom"), "s", "e"
            )
        )
    for a in q.atoms:
        if isinstance(a, Follow):
            parts.append(_node_spans(a, cs, q).select(*KEYS, F.lit(q.atom_id(a)).alias("atom"), "s", "e"))
    return reduce(DataFrame.unionByName, parts)


def _truth(node, q: Query) -> Column:
    if isinstance(node, (Chain, Follow)):
        return F.coalesce(F.col(f"_a{q.atom_id(node)}"), F.lit(False))
    if isinstance(node, Not):
        return ~_truth(node.part, q)
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, [_truth(p, q) for p in node.parts])
    if isinstance(node, Or):
        return reduce(lambda a, b: a | b, [_truth(p, q) for p in node.parts])
    raise TypeError(node)


def _flags(q: Query) -> list[Column]:
    """Per-fragment presence of each atom, as whole-partition window values."""
    frag = Window.partitionBy(*KEYS)
    return [F.max(F.when(F.col("atom") == i, F.lit(True))).over(frag).alias(f"_a{i}") for i in range(len(q.atoms))]


def with_truth(spans: DataFrame, q: Query) -> DataFrame:
    """Spans of fragments where the query holds (``content_tsv @@ q``); the
    boolean flags are window aggregates on the spans' own partitioning, so no
    join or extra shuffle is needed."""
    x = spans.select("*", *_flags(q))
    return x.filter(_truth(q.root, q)).select(*spans.columns)


def with_universe(rows: DataFrame, q: Query, universe: DataFrame | None, fill: dict) -> DataFrame:
    """Add one row per fragment of ``universe`` (columns ``fill`` null) when the
    query holds on a fragment without any atom (a negation): such fragments then
    go through the same per-fragment windows, with no anti-join and no second
    read of the postings."""
    if not truth_when_absent(q.root):
        return rows
    if universe is None:
        raise ValueError("this query needs the fragment universe")
    empty = universe.select(*KEYS, *[F.lit(None).cast(t).alias(c) for c, t in fill.items()])
    return rows.unionByName(empty)


def matching_fragments(spans: DataFrame, q: Query, universe: DataFrame | None) -> DataFrame:
    """Fragments ``(file_id, sequence_no)`` where the query is true (``@@``).

    A query that is true on a fragment without any atom (a negation) needs the
    fragment universe; otherwise only fragments with hits are looked at.
    """
    rows = with_universe(spans.select(*KEYS, "atom"), q, universe, {"atom": "int"})
    x = rows.select(*KEYS, *_flags(q))
    return x.filter(_truth(q.root, q)).select(*KEYS).distinct()


def _start(node, q: Query) -> Column | None:
    """Latest cover start reachable at the current end position (None = no part)."""
    if isinstance(node, (Chain, Follow)):
        return F.col(f"_r{q.atom_id(node)}")
    if isinstance(node, Not):
        return None
    parts = [c for c in (_start(p, q) for p in node.parts) if c is not None]
    if not parts:
        return None
    if len(parts) == 1:
        return parts[0]
    if isinstance(node, And):
        return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.least(*parts))
    return F.greatest(*parts)


def _density(s: Column, e: Column) -> Column:
    return F.lit(float(DENSITY_TOKENS)) / F.greatest(F.lit(DENSITY_TOKENS), e - s + 1)


def cover_rows(
    spans: DataFrame,
    q: Query,
    universe: DataFrame | None = None,
    truth: bool = True,
    keep_empty: bool = True,
) -> DataFrame:
    """Minimal covers ``(file_id, sequence_no, s, e, density)`` of each fragment.

    Rows are end positions in order; each atom keeps the latest start seen so
    far, AND takes the least of its parts, OR the greatest, negations are
    ignored; a cover ``[start, end]`` is minimal when its start moved past the
    previous one. With ``truth`` only fragments where the query holds are kept.
    With ``keep_empty`` a kept fragment without any cover gives one row of
    nulls (the outer lateral join of the reference); ``universe`` adds such rows
    for fragments without hits when the query holds there. All steps are
    windows over the spans' ``(file_id, sequence_no)`` partitioning.
    """
    n = len(q.atoms)
    per_end = spans.groupBy(*KEYS, "e").agg(
        *[F.max(F.when(F.col("atom") == i, F.col("s"))).alias(f"_m{i}") for i in range(n)]
    )
    if keep_empty and universe is not None and (not truth or truth_when_absent(q.root)):
        # every fragment of the universe gets a row without end (sorted first);
        # one without any cover keeps just that row
        fill = {"e": "int", **{f"_m{i}": "int" for i in range(n)}}
        if truth:
            per_end = with_universe(per_end, q, universe, fill)
        else:
            per_end = per_end.unionByName(universe.select(*KEYS, *[F.lit(None).cast(t).alias(c) for c, t in fill.items()]))
    frag = Window.partitionBy(*KEYS)
    upto = frag.orderBy("e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [*KEYS, "e", *[F.max(f"_m{i}").over(upto).alias(f"_r{i}") for i in range(n)]]
    if truth:
        cols += [F.max(f"_m{i}").over(frag).isNotNull().alias(f"_a{i}") for i in range(n)]
    x = per_end.select(*cols)
    if truth:
        x = x.filter(_truth(q.root, q))
    start = _start(q.root, q)
    x = x.select(*KEYS, "e", (start if start is not None else F.lit(None).cast("int")).alias("s"))
    ordered = frag.orderBy("e")
    x = x.withColumn("_prev", F.lag("s").over(ordered))
    x = x.withColumn("_cov", F.col("s").isNotNull() & (F.col("_prev").isNull() | (F.col("s") > F.col("_prev"))))
    if keep_empty:
        x = x.withColumns(
            {"_any": F.max(F.col("_cov").cast("int")).over(frag), "_first": F.row_number().over(ordered)}
        )
        x = x.filter(F.col("_cov") | ((F.col("_any") == 0) & (F.col("_first") == 1)))
    else:
        x = x.filter(F.col("_cov"))
    cov = F.col("_cov")
    return x.select(
        *KEYS,
        F.when(cov, F.col("s")).cast("int").alias("s"),
        F.when(cov, F.col("e")).cast("int").alias("e"),
        F.when(cov, _density(F.col("s"), F.col("e"))).alias("density"),
    )


def covers(spans: DataFrame, q: Query) -> DataFrame:
    """Minimal covers of the fragments where ``q`` holds (no null rows)."""
    return cover_rows(spans, q, None, truth=True, keep_empty=False)
