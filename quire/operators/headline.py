"""Headlines: top covers per book, widened windows over the token array, <b> marks.

Pieces are token ranges of ``content_array`` (no re-tokenising). Marks are
decided on the window's own lexemes (``_lx``, computed once per row): either
every occurrence of a positive word or phrase of the query, one mark per run
(``covered_flags`` + ``render_runs``), or every query word on its own
(``render_words``). Only word-distance atoms bring their spans (``marks``).
The renderers are single SQL expressions (one parse, evaluated per position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import present_text
from quire.operators.analyze import lexeme

KEYS = ["file_id", "sequence_no"]

# --- Fixed values: headline shape ---
TOP_COVERS = 5          # MaxFragments
MIN_WORDS = 15          # MinWords: a window is widened to at least this
MAX_WORDS = 35          # MaxWords: a window is cut here
PIECE_SEPARATOR = " ... "
MARK_OPEN = "<b>"
MARK_CLOSE = "</b>"


def rank_order() -> list[Column]:
    """Best cover first: density (nulls first, as a DESC sort of the reference
    database does), then shorter, earlier fragment, earlier start."""
    return [
        F.col("density").desc_nulls_first(),
        (F.col("e") - F.col("s")).asc_nulls_first(),
        F.col("sequence_no").asc(),
        F.col("s").asc_nulls_first(),
    ]


def top_covers(rows: DataFrame, k: int = TOP_COVERS) -> DataFrame:
    """Keep the ``k`` best rows per file (``rn`` 1..k); planned as a window group limit."""
    w = Window.partitionBy("file_id").orderBy(*rank_order())
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


#: Other covers whose window can overlap a given window: windows are at most MAX_WORDS
#: long and begin at most MIN_WORDS // 2 before their cover, and minimal covers of one
#: text have distinct starts.
NEAR_COVERS = 2 * (MAX_WORDS - 1) + MIN_WORDS // 2


def apart_covers(rows: DataFrame, k: int = TOP_COVERS) -> DataFrame:
    """Up to ``k`` covers per file whose widened windows do not overlap (``rn`` 1..k):
    best first, each that overlaps one taken before is passed over.

    A taken window rules out at most ``NEAR_COVERS`` others, so the choice lies in the
    first ``(k - 1) * (NEAR_COVERS + 1) + 1`` by rank: those are found by a group limit,
    and only they meet in a row per file. Rows without a cover overlap nothing."""
    ws, we = window_bounds(F.col("s"), F.col("e"), F.lit(2**31 - 1))  # a text's end cuts no overlap
    window = lambda c: F.when(F.col("s").isNotNull(), c)
    x = top_covers(rows, (k - 1) * (NEAR_COVERS + 1) + 1).withColumns({"_a": window(ws), "_z": window(we)})
    cols = [c for c in rows.columns if c != "file_id"]
    listed = F.array_sort(F.collect_list(F.struct("rn", "_a", "_z", *cols)))
    x = x.groupBy("file_id").agg(listed.alias("_c"))

    def overlaps(c: Column, d: Column) -> Column:
        near = (c["sequence_no"] == d["sequence_no"]) & (c["_a"] <= d["_z"]) & (d["_a"] <= c["_z"])
        return F.coalesce(near, F.lit(False))

    def take(taken: Column, c: Column) -> Column:
        return F.when((F.size(taken) >= k) | F.exists(taken, lambda d: overlaps(c, d)), taken).otherwise(F.concat(taken, F.array(c)))

    chosen = F.aggregate("_c", F.slice("_c", 1, 0), take)
    x = x.select("file_id", F.posexplode(chosen).alias("_i", "_t"))
    return x.select("file_id", *[F.col(f"_t.{c}").alias(c) for c in cols], (F.col("_i") + 1).alias("rn"))


def span_marks(spans: DataFrame) -> DataFrame:
    """Per fragment, the match spans as ``marks array<struct<s,e>>``."""
    return spans.groupBy(*KEYS).agg(F.collect_list(F.struct("s", "e")).alias("marks"))


def window_bounds(s: Column, e: Column, n: Column) -> tuple[Column, Column]:
    """Cover widened evenly to MIN_WORDS, cut at MAX_WORDS, clipped to 1..n.
    A row without a cover shows the first MIN_WORDS tokens."""
    length = e - s + 1
    ws0 = F.when(length >= MIN_WORDS, s).otherwise(s - F.floor((MIN_WORDS - length) / 2).cast("int"))
    we0 = F.when(length >= MIN_WORDS, F.least(e, s + (MAX_WORDS - 1))).otherwise(ws0 + (MIN_WORDS - 1))
    ws = F.when(s.isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), ws0))
    we = F.when(s.isNull(), F.least(n, F.lit(MIN_WORDS))).otherwise(F.least(n, we0))
    return ws, we


def join_pieces(piece: Column, order: Column) -> Column:
    """``STRING_AGG(piece, ' ... ')`` in ``order``; nulls skipped, null if none."""
    parts = F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct(order.alias("o"), piece.alias("p")))))
    return F.when(F.size(parts) > 0, present_text(F.array_join(F.transform(parts, lambda x: x["p"]), PIECE_SEPARATOR)))


def lexeme_window(tokens: Column, ws: Column, we: Column, reach: int, config: str) -> tuple[Column, Column]:
    """``(lo, lexemes)``: lexemes of tokens ``lo .. min(n, we + reach)`` with
    ``lo = max(1, ws - reach)``; only the window and its reach are analysed."""
    lo = F.greatest(F.lit(1), ws - reach)
    hi = F.least(F.size(tokens), we + reach)
    return lo, F.transform(F.sequence(lo, hi), lambda p: lexeme(F.element_at(tokens, p), config))


def sql_str(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def covered_flags(chains, with_marks: bool = False) -> Column:
    """``_cov``: for positions ``_lo .. _lo+size(_lx)-1`` whether an occurrence
    of one of ``chains`` (words or phrases) covers it, checked on the window's
    own lexemes ``_lx``; with ``with_marks`` also whether a span of ``marks``
    does. One SQL expression, evaluated once per position.

    Arrays used inside per-position lambdas are first bound to lambda variables
    (a one-element ``transform``): referenced there directly, Catalyst may
    inline their projection and recompute them for every position.
    """

    def lex_at(x: str) -> str:
        return f"get(lx, {x} - _lo)"

    alts = []
    for ch in chains:
        for off_j, _ in ch.terms:
            conds = [f"{lex_at(f'q + {off_i - off_j}')} = {sql_str(term)}" for off_i, term in ch.terms]
            alts.append("coalesce(" + " AND ".join(conds) + ", false)")
    if with_marks:
        alts.append("exists(coalesce(marks, array()), m -> m.s <= q AND q <= m.e)")
    body = " OR ".join(alts) if alts else "false"
    return F.expr(f"element_at(transform(array(_lx), lx -> transform(sequence(_lo, _lo + size(lx) - 1), q -> {body})), 1)")


def render_runs(tokens: str = "content_array", offset: str = "0") -> Column:
    """Tokens ``_ws.._we`` joined by blanks; each run of covered positions
    (``_cov``) is wrapped in one ``<b>…</b>``. Position ``p`` is element
    ``p - offset`` of the ``tokens`` array."""
    c = "coalesce(get(b.c, {x} - _lo), false)"
    here, prev, nxt = c.format(x="p"), c.format(x="p - 1"), c.format(x="p + 1")
    return F.expr(
        f"element_at(transform(array(named_struct('c', _cov, 't', {tokens})), b -> "
        f"array_join(transform(sequence(_ws, _we), p -> concat("
        f"CASE WHEN {here} AND (p = _ws OR NOT {prev}) THEN {sql_str(MARK_OPEN)} ELSE '' END, "
        f"element_at(b.t, p - {offset}), "
        f"CASE WHEN {here} AND (p = _we OR NOT {nxt}) THEN {sql_str(MARK_CLOSE)} ELSE '' END)), ' ')), 1)"
    )


def render_words(words: list[str], tokens: str = "content_array", offset: str = "0") -> Column:
    """Tokens ``_ws.._we``; each token whose lexeme is a query word is marked on
    its own. Position ``p`` is element ``p - offset`` of ``tokens``."""
    wanted = ", ".join(sql_str(w) for w in sorted(set(words))) or "NULL"
    hit = f"coalesce(get(b.l, p - _lo) IN ({wanted}), false)"
    tok = f"element_at(b.t, p - {offset})"
    return F.expr(
        f"element_at(transform(array(named_struct('l', _lx, 't', {tokens})), b -> "
        f"array_join(transform(sequence(_ws, _we), p -> CASE WHEN {hit} "
        f"THEN concat({sql_str(MARK_OPEN)}, {tok}, {sql_str(MARK_CLOSE)}) "
        f"ELSE {tok} END), ' ')), 1)"
    )
