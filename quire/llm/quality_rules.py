"""Quality rules: base limits, then boosted trees over document statistics.

``statistics`` computes every statistic of a batch of whole texts with numpy; the
trees are trained on a bounded sample of the labelled rows (``SAMPLE`` per class,
those with the smallest hashes of their ids) and scored in the same pass that
computes the statistics: no shuffle of the texts.

Monotone features (the score may only fall as they grow): share of symbols, share
of repeated words, share of repeated lines, share of capitals.

Repeated words are exact: words get integer names, windows of 8 are named by
naming pairs of pairs of pairs, so equal names mean equal windows.

Cases: null, empty or blank text: all statistics 0, base_failed (too few words).
Null doc_id: scored like any other, never a training row. Labels with a null or
with two different values for one doc_id do not train; without labels of both
kinds the prior alone decides. Equal rows: a row each. Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.boosting import Forest, train
from quire.llm.textblocks import Block, blocks, words

SAMPLE = 2000  # labelled training rows of each class
THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "repeated", "dup_lines", "capitals", "digits", "bars", "stops", "commas", "shouts", "other", "line_words", "short_words", "long_words", "variety"]
MONOTONE = np.array([0, 0, -1, -1, -1, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _bytes("#*$%&|<>"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
_BAR, _STOP, _COMMA, _SHOUT = _bytes("|"), _bytes("."), _bytes(",;:"), _bytes("!?")
_OTHER = _bytes("\"'()[]{}=+/\\_@^`~-")


def _names(pairs: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal values get equal small integers."""
    uniq, back = np.unique(pairs, return_inverse=True)
    return back, len(uniq)


def repeated_words(names: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of each text, the words that stand in a window found twice or more in it."""
    n = len(names)
    out = np.zeros(len(bounds) - 1, np.int64)
    if n < window:
        return out
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    size, name = 1, names
    while size < window:  # the window is a power of two
        name, _ = _names(name[:-size].astype(np.int64) * (int(name.max(initial=0)) + 1) + name[size:])
        size *= 2
    at = np.flatnonzero(np.arange(n - window + 1) + window <= bounds[1:][row[: n - window + 1]])
    key, kinds = _names(row[at] * np.int64(int(name.max(initial=0)) + 1) + name[at])
    twice = at[np.bincount(key, minlength=kinds)[key] > 1]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def duplicate_lines(block: Block) -> np.ndarray:
    """Of each text, the lines with a word that equal an earlier line."""
    data, bounds = block.data, block.bounds
    cut = np.flatnonzero(data == 10)
    starts = np.union1d(cut + 1, bounds[:-1][np.diff(bounds) > 0])
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(block.n, np.int64)
    text = block.row_of(starts)
    stop = np.append(starts[1:], len(data))
    ends = np.where((stop > starts) & (data[stop - 1] == 10) & (stop <= bounds[text + 1]), stop - 1, stop)
    solid = np.concatenate([[0], np.cumsum((data > 0x20) | ((data < 0x20) & ((data < 9) | (data > 13))))])
    keep = solid[ends] > solid[starts]
    starts, ends, text = starts[keep], ends[keep], text[keep]
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)])), pa.py_buffer(data[_spread(starts, ends)])])
    name = np.asarray(lines.dictionary_encode().indices)
    _, first = np.unique(text * np.int64(len(name) + 1) + name, return_index=True)
    return np.bincount(text, minlength=block.n) - np.bincount(text[first], minlength=block.n)


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from quire.llm.textblocks import ragged

    return ragged(starts, ends - starts)


def word_names(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words of a block get equal small integers (by their bytes)."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(block.data[_spread(starts, ends)])])
    return np.asarray(array.dictionary_encode().indices).astype(np.int64)


def statistics(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (n x 5) and the trees' features (n x 16) of each text."""
    w = words(block, hashed=False)
    data, n_words = block.data, w.counts
    points = (data & 0xC0) != 0x80
    blank = (data == 0x20) | ((data >= 9) & (data <= 13))
    chars = block.per_text(points & ~blank)
    names = word_names(block, w.starts, w.ends)
    repeat = repeated_words(names, w.bounds)
    dup = duplicate_lines(block)
    count = lambda table: block.per_text(table[data])
    symbols, lines = count(_SYMBOL), block.per_text(data == 10) + 1
    per_word, per_char = np.maximum(n_words, 1), np.maximum(chars, 1)
    short, long = (np.concatenate([[0], np.cumsum(x)]) for x in (w.ends - w.starts <= 3, w.ends - w.starts >= 15))
    of = lambda c: c[w.bounds[1:]] - c[w.bounds[:-1]]
    kinds = np.bincount(np.unique(w.rows() * np.int64(len(names) + 1) + names) // (len(names) + 1), minlength=block.n)
    base = np.stack([n_words, chars, symbols, dup, repeat], axis=1)
    features = np.stack(
        [
            np.log1p(n_words), chars / per_word, symbols / per_char, repeat / per_word, dup / lines,
            count(_UPPER) / per_char, count(_DIGIT) / per_char, count(_BAR) / per_word, count(_STOP) / per_word,
            count(_COMMA) / per_word, count(_SHOUT) / per_word, count(_OTHER) / per_char, n_words / lines,
            of(short) / per_word, of(long) / per_word, kinds / np.sqrt(per_word),
        ],
        axis=1,
    )
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEATED_PERCENT * base[:, 0])


# ------------------------------------------------------------------ jobs
def training_ids(labels: DataFrame, column: str, sample: int, where=None) -> DataFrame:
    """At most ``sample`` labelled doc_ids of each class: doc_id, label."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    one = one.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other")).filter("label = other")
    if where is not None:
        one = one.filter(where)
    pick = lambda k: one.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return pick(0).union(pick(1)).select("doc_id", F.col("label").cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, where=None) -> Forest:
    """Train on a bounded sample (``2 * sample`` rows of 16 numbers reach the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                _, x = statistics(block)
                rows = batch.slice(block.first, block.n)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), flat], names=["doc_id", "label", "x"])

    ids = training_ids(labels, "quality", sample, where)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")  # at most 2 * sample ids
    got = rows.mapInArrow(run, "doc_id long, label int, x array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    y = np.array([r["label"] for r in got], np.float64)
    share = 1 - labels_share(labels)
    if len(y) and 0 < y.sum() < len(y) and 0 < share < 1:
        forest = train(x, y, MONOTONE)
        drawn = 1 - y.mean()  # back from the sample's classes to the labels' own
        forest.prior += float(np.log((1 - share) / share) - np.log((1 - drawn) / drawn))
        return forest
    return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 1.0)


def labels_share(labels: DataFrame) -> float:
    """The share of label 1 among usable labels (0.5 without any)."""
    r = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()
    return 0.5 if r[0] is None else float(r[0])


def judge(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the five counts, base_failed, score, kept for every row."""
    broadcast = docs.sparkSession.sparkContext.broadcast(forest)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                base, x = statistics(block)
                failed, score = base_failed(base), broadcast.value.probability(x)
                columns = [batch.column(0).slice(block.first, block.n), *(pa.array(c, pa.int64()) for c in base.T), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def kept_documents(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, in one narrow pass with all their columns."""
    broadcast = docs.sparkSession.sparkContext.broadcast(forest)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text)):
                base, x = statistics(block)
                keep = ~base_failed(base) & (broadcast.value.probability(x) >= threshold)
                yield batch.slice(block.first, block.n).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
