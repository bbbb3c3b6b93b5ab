"""Whole search operations (the public API).

* ``search_files(index, query, mode, strategy)`` - corpus search with a headline
  per book: ``ts_fast_headline`` (covers within fragments), ``ts_headline`` and
  ``ts_semantic_headline`` (covers over whole books, served from the index).
* ``file_contents`` - one book (or all).
* ``file_matches`` - matched passages of one book (or all), at most ``limit`` per fragment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import present_text
from quire.operators.analyze import lexeme
from quire.operators.headline import (
    apart_covers,
    covered_flags,
    join_pieces,
    lexeme_window,
    render_runs,
    render_words,
    span_marks,
    window_bounds,
)
from quire.operators.match import KEYS, atom_spans, cover_rows, matching_fragments, with_truth
from quire.operators.query import And, Chain, Follow, Not, Or, Query, compile_query
from quire.plans.index import BOOK_FIELDS, TextIndex

STRATEGIES = ("ts_headline", "ts_semantic_headline", "ts_fast_headline")
# Default number of matches listed per fragment (an argument of the call).
MATCHES_PER_FRAGMENT = 50

FAST_SCHEMA = "file_id long, headline string, title string, author string"
FULL_SCHEMA = "file_id long, filename string, title string, author string, headline string"


def _empty(index: TextIndex, schema: str) -> DataFrame:
    return index.spark.createDataFrame([], schema)


def positive_lexemes(node) -> list[str]:
    """Lexemes that can be hits (not under a negation)."""
    out: set[str] = set()

    def walk(n):
        if isinstance(n, Chain):
            out.update(t for _, t in n.terms)
        elif isinstance(n, Follow):
            for side in (n.left, n.right):
                if not isinstance(side, Not):
                    walk(side)
        elif isinstance(n, (And, Or)):
            for p in n.parts:
                walk(p)

    if node is not None:
        walk(node)
    return sorted(out)


def match(index: TextIndex, q: Query, file_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(spans, fragments)`` of fragments where ``q`` holds (``content_tsv @@ q``).

    ``spans(file_id, sequence_no, atom, s, e)`` are the atom matches inside those
    fragments; ``fragments(file_id, sequence_no)`` the matching fragment keys.
    """
    spans = atom_spans(index.match_lists(q, file_id), q, index.co_partitioned)
    frags = matching_fragments(spans, q, index.universe(file_id))
    return with_truth(spans, q), frags


def _positive_ids(q: Query) -> list[int]:
    return [q.atom_id(a) for a in q.positive]


def _with_pieces(
    top: DataFrame, q: Query, config: str, spans, words: bool = False, tokens: str = "content_array"
) -> DataFrame:
    """Add ``piece``: the cover window of each row with its matches marked.

    The window's lexemes are computed once (``_lx`` from ``_lo``); word and
    phrase atoms are re-checked on them, so no list of match spans travels with
    the row; only a query with a word-distance atom joins its spans (to the
    top rows only). ``words`` marks every query word on its own instead.
    ``spans`` is a frame of atom spans, or a function giving it (built only
    when needed).
    """
    chains = [a for a in q.positive if isinstance(a, Chain)]
    follows = [a for a in q.positive if isinstance(a, Follow)]
    ws, we = window_bounds(F.col("s"), F.col("e"), F.size(tokens))
    x = top.withColumns({"_ws": ws, "_we": we})
    reach = max([c.last for c in chains], default=0)
    lo, lx = lexeme_window(F.col(tokens), F.col("_ws"), F.col("_we"), reach, config)
    x = x.withColumns({"_lo": lo, "_lx": lx})
    if words:
        return x.withColumn("piece", render_words(positive_lexemes(q.root), tokens))
    if follows:
        ids = [q.atom_id(a) for a in follows]
        spans = spans() if callable(spans) else spans
        x = x.join(span_marks(spans.filter(F.col("atom").isin(ids))), KEYS, "left")
    x = x.withColumn("_cov", covered_flags(chains, with_marks=bool(follows)))
    return x.withColumn("piece", render_runs(tokens))


def search_fast(index: TextIndex, query: str, mode: str = "logical") -> DataFrame:
    """``file_id, headline, title, author``; headline = up to 5 best covers over
    pre-computed fragments whose windows do not overlap, joined by ' ... ' (best last).

    One postings lookup, one shuffle of the hits by fragment (none on bucketed
    tables), then windows on that partitioning (truth, covers, the null row of
    a matching fragment without cover); a shuffle of at most 5 rows per book
    and partition for the top-5, and the token arrays of the chosen fragments
    joined last.
    """
    q = compile_query(index.spark, query, mode, index.config)
    if q.empty:
        return _empty(index, FAST_SCHEMA)
    spans = atom_spans(index.match_lists(q), q, index.co_partitioned)
    rows = cover_rows(spans, q, index.universe())
    meta = ["title", "author"] if index.book_fields_on_fragments else []
    top = apart_covers(rows)
    top = index.join_fragments(top, ["content_array", *meta])
    top = _with_pieces(top, q, index.config, lambda: with_truth(spans, q))
    piece = F.when(F.col("s").isNotNull(), F.col("piece"))
    heads = top.groupBy("file_id", *meta).agg(join_pieces(piece, -F.col("rn")).alias("headline"))
    if not meta:  # fragments without book fields: take them from files
        heads = heads.join(index.files.select("file_id", "title", "author"), "file_id")
    return heads.select("file_id", "headline", "title", "author")


def search_full(index: TextIndex, query: str, mode: str = "logical", semantic: bool = False) -> DataFrame:
    """``file_id, filename, title, author, headline`` for books with a
    matching fragment; the headline is cut from the whole book.

    ``semantic`` marks whole match spans (a phrase is one mark); otherwise each
    query word is marked on its own. A book without any cover shows its first
    words unmarked.

    The book is not re-analysed: fragments tile its words in order, so a
    posting's book position is ``word_offset + pos``. Covers are computed per
    book on those positions (phrases may cross fragment borders, as in the
    whole text), up to five whose windows do not overlap are taken, and each window's tokens are gathered from the few fragments
    it overlaps (a join on ``file_id`` with a range condition, at most five
    windows per book).
    """
    q = compile_query(index.spark, query, mode, index.config)
    if q.empty:
        return _empty(index, FULL_SCHEMA)
    # one read and one shuffle of the hits, by book, serves both levels (the exchange
    # is reused): fragment truth, with a fragment named by its word offset, and covers
    # on book positions. Nothing may be pushed below the shuffle on one level only: ids are
    # filtered before it, and the matching books are joined (a semi-join would be pushed).
    lists = index.match_lists(q, by_book=True).select("lexeme", "file_id", "word_offset", "positions").filter(F.col("file_id").isNotNull())
    if not index.co_partitioned:
        lists = lists.repartition("file_id")
    by_offset = F.col("word_offset").alias("sequence_no")
    in_fragments = atom_spans(lists.select("lexeme", "file_id", by_offset, "positions"), q, True)
    books = matching_fragments(in_fragments, q, index.fragment_rows().select("file_id", by_offset)).select("file_id").distinct()
    layout = index.fragment_rows().select("file_id", "word_offset", "n_words").join(books, "file_id", "left_semi")
    in_book = lists.join(books, "file_id").select("lexeme", "file_id", "word_offset", F.explode_outer("positions").alias("pos"))
    in_book = in_book.filter(F.col("pos").isNotNull()).select(
        "lexeme", "file_id", F.lit(1).alias("sequence_no"), (F.col("pos") + F.col("word_offset")).alias("pos")
    )
    spans = atom_spans(in_book, q, True)  # book keys: (file_id, 1)
    top = apart_covers(cover_rows(spans, q, None, truth=False, keep_empty=False)).drop("sequence_no")
    sizes = layout.groupBy("file_id").agg(F.max(F.col("word_offset") + F.col("n_words")).alias("_n"))
    rows = sizes.join(top, "file_id", "left")  # a book without cover keeps one row of nulls

    chains = [a for a in q.positive if isinstance(a, Chain)]
    reach = max([c.last for c in chains], default=0)
    ws, we = window_bounds(F.col("s"), F.col("e"), F.col("_n"))
    rows = rows.withColumns({"_ws": ws, "_we": we, "_rk": F.coalesce(F.col("rn"), F.lit(0))})
    rows = rows.withColumns(
        {"_lo": F.greatest(F.lit(1), F.col("_ws") - reach), "_hi": F.least(F.col("_n"), F.col("_we") + reach)}
    )
    # tokens of positions _lo.._hi from the fragments that overlap them (with the
    # book fields, when fragments carry them)
    meta = list(BOOK_FIELDS) if index.book_fields_on_fragments else []
    f = index.fragment_rows().select(
        F.col("file_id").alias("_f"), "sequence_no", "word_offset", "n_words", "content_array", *meta
    )
    pairs = rows.join(
        f,
        (rows["file_id"] == f["_f"])
        & (f["word_offset"] < rows["_hi"])
        & (f["word_offset"] + f["n_words"] >= rows["_lo"]),
    )
    first = F.greatest(F.col("_lo"), F.col("word_offset") + 1)
    last = F.least(F.col("_hi"), F.col("word_offset") + F.col("n_words"))
    part = F.slice("content_array", first - F.col("word_offset"), last - first + 1)
    keys = ["file_id", "_rk", "s", "e", "_ws", "_we", "_lo", *meta]
    win = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sequence_no", part.alias("t")))).alias("_p"))
    win = win.withColumn("_toks", F.flatten(F.transform("_p", lambda x: x["t"])))
    win = win.withColumn("_lx", F.transform("_toks", lambda t: lexeme(t, index.config)))
    if semantic:
        follows = [a for a in q.positive if isinstance(a, Follow)]
        if follows:
            # only the spans that reach into one of a book's (five) windows are gathered
            near = spans.filter(F.col("atom").isin([q.atom_id(a) for a in follows])).select(F.col("file_id").alias("_f"), F.col("s").alias("_s"), F.col("e").alias("_e"))
            inside = rows.join(near, (F.col("file_id") == F.col("_f")) & (F.col("_s") <= F.col("_we")) & (F.col("_e") >= F.col("_ws")))
            marks = inside.groupBy("file_id", "_rk").agg(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"))).alias("marks"))
            win = win.join(marks, ["file_id", "_rk"], "left")
        win = win.withColumn("_cov", covered_flags(chains, with_marks=bool(follows)))
        piece = render_runs("_toks", offset="(_lo - 1)")
    else:
        piece = render_words(positive_lexemes(q.root), "_toks", offset="(_lo - 1)")
    heads = win.withColumn("piece", piece).groupBy("file_id", *meta).agg(
        join_pieces(F.col("piece"), F.coalesce(F.col("s"), F.lit(0))).alias("headline")
    )
    if not meta:
        heads = heads.join(index.files.select("file_id", "filename", "title", "author"), "file_id")
    return heads.select("file_id", "filename", "title", "author", "headline")


def search_files(index: TextIndex, query: str, mode: str = "logical", strategy: str = "ts_fast_headline") -> DataFrame:
    """Corpus search; ``strategy`` picks the headline (ValueError if unknown)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if strategy == "ts_fast_headline":
        return search_fast(index, query, mode)
    return search_full(index, query, mode, semantic=strategy == "ts_semantic_headline")


def file_contents(index: TextIndex, file_id: int | None = None) -> DataFrame:
    """``filename, title, author, content`` of one book (all books if None,
    then with ``file_id``)."""
    cols = ["filename", "title", "author", "content"]
    if file_id is None:
        return index.files.select("file_id", *cols)
    return index.file_rows(int(file_id)).select(*cols)


def file_matches(
    index: TextIndex, query: str, mode: str = "logical", file_id: int | None = None, limit: int = MATCHES_PER_FRAGMENT
) -> DataFrame:
    """E5: matched passages as ``term``, the first ``limit`` per fragment by position.

    With ``file_id=None`` every book is searched and ``file_id, sequence_no, s``
    are kept with the term.
    """
    q = compile_query(index.spark, query, mode, index.config)
    schema = "term string" if file_id is not None else "file_id long, sequence_no int, s int, term string"
    if q.empty:
        return _empty(index, schema)
    fid = None if file_id is None else int(file_id)
    spans, _ = match(index, q, fid)
    spans = spans.filter(F.col("atom").isin(_positive_ids(q))).select(*KEYS, "s", "e").distinct()
    w = Window.partitionBy(*KEYS).orderBy("s", "e")
    spans = spans.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= int(limit))
    out = index.join_fragments(spans, ["content_array"], fid).select(
        *KEYS,
        "s",
        present_text(
            F.array_join(F.slice("content_array", F.col("s"), F.col("e") - F.col("s") + 1), " ")
        ).alias("term"),
    )
    return out.select("term") if file_id is not None else out
