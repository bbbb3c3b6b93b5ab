"""Text analysis and index build: fragments, token arrays, lexeme vectors, postings.

All steps are narrow per-book projections (no shuffle): a book's tokens are cut
into fragments with array slices, so the largest row any task holds is one book
and every later row is one fragment of at most ``max_tokens`` tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import DEFAULT_MAX_TOKENS, is_word, simple_lexeme, tokens

CONFIGS = ("simple", "english", "english_revised")
KNOWN_STEMS = 1 << 18  # words whose stem a Python worker remembers


def check_config(config: str) -> str:
    if config not in CONFIGS:
        raise ValueError(f"unknown text search configuration {config!r}; use one of {CONFIGS}")
    return config


def stemming(config: str):
    """Stop words, stemmer as a Column and its Python twin of a stemming configuration."""
    from quire.functions import revised, stem

    return {
        "english": (stem.ENGLISH_STOP_WORDS, stem.porter_stem, stem.porter_stem_py),
        "english_revised": (revised.STOP_WORDS, revised.revised_stem, revised.revised_stem_py),
    }[config]


def lexeme(token: Column, config: str = "simple") -> Column:
    """Lexeme of a word token; null when the configuration drops it (stop word)."""
    check_config(config)
    base = simple_lexeme(token)
    if config == "simple":
        return base
    stops, stem, _ = stemming(config)
    return F.when(base.isin(list(stops)), F.lit(None).cast("string")).otherwise(stem(base))


def lexeme_vector(words: Column) -> Column:
    """``array<struct<lexeme,pos>>`` of a word array with ``simple`` lexemes;
    positions are 1-based. Other configurations map these lexemes through the
    vocabulary (``vocabulary`` / ``postings``), so positions of dropped words
    (stop words) stay taken."""
    return F.transform(words, lambda t, i: F.struct(simple_lexeme(t).alias("lexeme"), (i + 1).alias("pos")))


def fragments(
    files: DataFrame, max_tokens: int | None = DEFAULT_MAX_TOKENS, config: str = "simple", keep: tuple = ()
) -> DataFrame:
    """Cut each book into fragments.

    ``files(file_id, content)`` -> ``fragments(file_id, sequence_no, content_array,
    content_tsv, content)``. Fragment ``k`` holds raw tokens ``k*m+1 .. (k+1)*m``;
    its ``content_array`` keeps the word tokens, so ``content_array[pos-1]`` is the
    token at ``pos``. Fragments without any word are dropped before numbering.
    ``max_tokens=None`` keeps each book whole (one fragment). ``content_tsv``
    holds ``simple`` lexemes whatever the configuration (see ``postings``).
    ``keep`` names further columns of ``files`` carried to every fragment.
    ``word_offset`` / ``n_words`` place the fragment among the book's words.
    """
    check_config(config)
    raw = files.select("file_id", *keep, tokens(F.col("content")).alias("_raw"))
    if max_tokens is None:
        pieces = F.array(F.col("_raw"))
    else:
        m = int(max_tokens)
        if m < 1:
            raise ValueError("max_tokens must be positive")
        last = F.greatest(F.floor((F.size("_raw") - 1) / m).cast("int"), F.lit(0))
        pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("_raw", k * m + 1, m))
    parts = F.transform(
        pieces,
        lambda f: F.struct(F.array_join(f, " ").alias("content"), F.filter(f, is_word).alias("words")),
    )
    kept = F.filter(parts, lambda p: F.size(p["words"]) > 0)
    # the fragment array is materialized once (it feeds two expressions below)
    raw = raw.select("file_id", *keep, kept.alias("_kept"))
    # word_offset: words of the book before this fragment (fragments tile the
    # book's words in order), so book position = word_offset + pos
    sizes = F.transform("_kept", lambda p: F.size(p["words"]))
    # an outer generator gets no inferred `size(...) > 0` filter, which Catalyst
    # would push below the projections and so tokenize every book again; the
    # null row of a book without fragments is dropped after the generator
    out = raw.select("file_id", *keep, sizes.alias("_n"), F.posexplode_outer("_kept").alias("_i", "_f"))
    out = out.filter(F.col("_f").isNotNull())
    return out.select(
        "file_id",
        *keep,
        (F.col("_i") + 1).cast("int").alias("sequence_no"),
        F.col("_f.words").alias("content_array"),
        lexeme_vector(F.col("_f.words")).alias("content_tsv"),
        F.col("_f.content").alias("content"),
        F.aggregate(F.slice("_n", 1, F.col("_i")), F.lit(0), lambda a, x: a + x).cast("int").alias("word_offset"),
        F.size("_f.words").cast("int").alias("n_words"),
    )


def vocabulary(frags: DataFrame, config: str = "english") -> DataFrame:
    """T6 vocabulary job: ``(lexeme, term)`` for every distinct simple lexeme
    that the configuration keeps (stop words left out), each stemmed once."""
    check_config(config)
    lex = frags.select(F.explode_outer("content_tsv.lexeme").alias("lexeme")).filter(F.col("lexeme").isNotNull())
    lex = lex.distinct()
    if config == "simple":
        return lex.select("lexeme", F.col("lexeme").alias("term"))
    stops, stem, _ = stemming(config)
    kept = lex.filter(~F.col("lexeme").isin(list(stops)))
    return kept.select("lexeme", stem(F.col("lexeme")).alias("term"))


@lru_cache(KNOWN_STEMS)
def known_stem(config: str, word: str) -> str:
    """The stem of a word, remembered by a Python worker for its next tasks too."""
    return stemming(config)[2](word)


def _coded_terms(words: pa.ListArray, config: str, stops: frozenset, wanted: frozenset | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per row, a code per word and the terms of the codes (null: dropped). Each word
    of a batch is looked up once, so no occurrence leaves its row: no vocabulary is joined,
    and nothing is shuffled."""

    def term(word: str | None) -> str | None:
        if word is None or word in stops:
            return None
        found = word if config == "simple" else known_stem(config, word)
        return found if wanted is None or found in wanted else None

    coded = words.flatten().dictionary_encode()
    terms = coded.dictionary if config == "simple" and wanted is None else pa.array([term(w) for w in coded.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return sizes, coded.indices.to_numpy(zero_copy_only=False), terms


def _by_term(frags: DataFrame, config: str, lexemes: list[str] | None, work, schema: str) -> DataFrame:
    """``work(batch, sizes, codes, terms)`` over the lexemes of batches of fragments."""
    stops = frozenset() if config == "simple" else frozenset(stemming(config)[0])
    wanted = None if lexemes is None else frozenset(lexemes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch, *_coded_terms(batch.column("_terms"), config, stops, wanted))

    rows = frags.select(F.col("file_id").cast("long"), "sequence_no", "word_offset", F.col("content_tsv.lexeme").alias("_terms"))
    return rows.mapInArrow(run, schema)


def _list_array(sizes: np.ndarray, values) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def stemmed(frags: DataFrame, config: str, lexemes: list[str] | None = None) -> DataFrame:
    """``(file_id, sequence_no, word_offset, _terms)``: the stem of each word of a fragment,
    null for stop words (and for stems not among ``lexemes``, when given)."""

    def work(batch: pa.RecordBatch, sizes: np.ndarray, codes: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
        column = _list_array(sizes, terms.take(pa.array(codes)))
        return batch.set_column(batch.schema.get_field_index("_terms"), "_terms", column)

    return _by_term(frags, config, lexemes, work, "file_id long, sequence_no int, word_offset int, _terms array<string>")


def lists_of(batch: pa.RecordBatch, sizes: np.ndarray, codes: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    """The position lists of a batch: occurrences ordered by term and fragment (stably, so
    positions ascend) and cut where either changes. In that order a sort of what is written
    only has to merge batches."""
    places = terms.dictionary_encode()  # words of one stem become one
    by_name = pc.sort_indices(places.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    coded = places.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    of_code = np.append(rank, -1)[coded]
    term = of_code[codes]
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    kept = np.flatnonzero(term >= 0)
    key = term[kept] * len(sizes) + row[kept]
    order = np.argsort(key, kind="stable")
    key, kept = key[order], kept[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    found, row = term[kept[first]], pa.array(row[kept[first]])
    lists = _list_array(np.diff(first, append=len(kept)), pa.array(pos[kept].astype(np.int32)))
    columns = [places.dictionary.take(pa.array(by_name[found])), *(batch.column(c).take(row) for c in ("file_id", "sequence_no")), lists, batch.column("word_offset").take(row)]
    return pa.RecordBatch.from_arrays(columns, names=["lexeme", "file_id", "sequence_no", "positions", "word_offset"])


def stemmed_vector() -> Column:
    """The lexeme vector of ``stemmed`` rows; positions of dropped words stay taken."""
    every = F.transform("_terms", lambda t, i: F.struct(t.alias("lexeme"), (i + 1).alias("pos")))
    return F.filter(every, lambda x: x["lexeme"].isNotNull())


def postings(
    frags: DataFrame, lexemes: list[str] | None = None, config: str = "simple", offsets: bool = False
) -> DataFrame:
    """Inverted index rows ``(lexeme, file_id, sequence_no, pos)`` (T7); with
    ``offsets`` also ``word_offset``: ``word_offset + pos`` is the place in the book.

    With ``lexemes`` the vector is filtered *before* the explode, so only query
    hits become rows (the in-plan equivalent of an index lookup). Under a
    configuration other than ``simple`` a fragment's lexemes are stemmed in its own row
    (``stemmed``). A written index holds the stems, so its searches do without.
    """
    check_config(config)
    tsv = F.col("content_tsv")
    if config != "simple":
        frags, tsv = stemmed(frags, config, lexemes), stemmed_vector()
    elif lexemes is not None:
        wanted = sorted(set(lexemes))
        tsv = F.filter(tsv, lambda x: x["lexeme"].isin(wanted)) if wanted else F.array().cast(frags.schema["content_tsv"].dataType)
    more = ["word_offset"] if offsets else []
    rows = frags.select("file_id", "sequence_no", *more, F.explode_outer(tsv).alias("_p")).filter(F.col("_p").isNotNull())
    return rows.select(
        F.col("_p.lexeme").alias("lexeme"),
        "file_id",
        "sequence_no",
        F.col("_p.pos").alias("pos"),
        *more,
    )


def position_lists(frags: DataFrame, lexemes: list[str] | None = None, config: str = "simple") -> DataFrame:
    """The inverted index as position lists (T7): one row per lexeme and fragment,
    ``(lexeme, file_id, sequence_no, positions, word_offset)``, positions ascending.

    A fragment's lists are made in its own row. Some lexemes of a ``simple`` index are
    filtered by an expression (few words come through); else batches of fragments are
    ordered and cut as arrays (``lists_of``), stems looked up on the way."""
    check_config(config)
    wanted = None if lexemes is None else sorted(set(lexemes))
    if config != "simple" or wanted is None:
        return _by_term(frags, config, wanted, lists_of, "lexeme string, file_id long, sequence_no int, positions array<int>, word_offset int")
    tsv = F.col("content_tsv")
    tsv = F.filter(tsv, lambda x: x["lexeme"].isin(wanted)) if wanted else F.slice(tsv, 1, 0)
    # arrays used inside lambdas are bound to lambda variables, so that they are computed once
    firsts = "CASE WHEN size(v) = 0 THEN array() ELSE filter(sequence(1, size(v)), i -> i = 1 OR v[i - 1].lexeme <> v[i - 2].lexeme) END"
    lists = (
        "transform(b, (a, k) -> named_struct('lexeme', v[a - 1].lexeme, 'positions', "
        "transform(slice(v, a, coalesce(get(b, k + 1), size(v) + 1) - a), x -> x.pos)))"
    )
    cut = F.expr(f"element_at(transform(array(_v), v -> element_at(transform(array({firsts}), b -> {lists}), 1)), 1)")
    rows = frags.select("file_id", "sequence_no", "word_offset", F.sort_array(tsv).alias("_v"))
    rows = rows.select("file_id", "sequence_no", "word_offset", F.explode_outer(cut).alias("_l")).filter(F.col("_l").isNotNull())
    return rows.select(F.col("_l.lexeme").alias("lexeme"), "file_id", "sequence_no", F.col("_l.positions").alias("positions"), "word_offset")


def occurrences(lists: DataFrame) -> DataFrame:
    """Position lists as one row per occurrence: ``(lexeme, file_id, sequence_no, pos, word_offset)``."""
    x = lists.select("lexeme", "file_id", "sequence_no", F.explode_outer("positions").alias("pos"), "word_offset")
    return x.filter(F.col("pos").isNotNull())


def lexicon(lists: DataFrame) -> DataFrame:
    """``(lexeme, n_fragments)``: in how many fragments each lexeme stands."""
    return lists.groupBy("lexeme").agg(F.count("*").alias("n_fragments"))
