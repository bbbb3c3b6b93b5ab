"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i < t every element falls
into a hashed bin with value i + h; round t + j puts every element into bin j.
A coordinate keeps its smallest value, so after 2t rounds every coordinate is
filled; texts stop taking part as soon as all their bins are full. Coordinates
agree with the probability of the sets' Jaccard similarity, concentrated as by a
fresh sample.

1. ``prepare``: words, distinct k-word shingles (64-bit hashes), the set's digest,
   sketch, ``bands`` band hashes of ``rows`` coordinates. A narrow pass.
2. Documents of equal sets are one class (smallest doc_id), found by a
   min-aggregation. All further work is on classes of different texts.
3. Each class is linked with the smallest class of all its band buckets, if the
   full sets agree (one pair per class); components of those links.
4. A bucket whose members lie in one component has nothing left to find. In every
   other bucket all pairs over different components are compared on full sets,
   inside tasks, block against block (about ``BLOCK_MEMBERS``), with matrix
   products; only a spanning forest of the links found leaves the task.
5. Components of all links.

Nothing is capped: a bucket of any size is cut into blocks and every pair of
blocks that may hold a link becomes one row group. ``rows`` and ``bands`` make the chance that a
link has no common bucket about 1e-5 or less at the threshold.

Cases: null or blank text: no shingles, a component of its own. Null doc_id: kept,
linked with nothing, component null. Rows of one doc_id are one node: they share
a component. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import run_folder, written
from quire.llm.textblocks import blocks, grams, mix64, runs, words

COORDINATES = 224
MISSED = 1e-5  # allowed chance that a link at the threshold shares no bucket
BANDS = 32  # at most so many bands: their rows are what is shuffled
BLOCK_MEMBERS = 512
BLOCK_COLUMNS = 4096
BLOCK_TEXTS = 2048
BLOCK_BYTES = 4 << 20  # sketches make several hundred rounds per block


def banding(percent: int) -> tuple[int, int]:
    """Rows per band and bands: the longest rows that still find a link; for low
    percents one row and more than ``BANDS`` bands."""
    best = None
    for rows in range(1, COORDINATES // 2):
        same = (percent / 100) ** rows
        if 1 - same == 1:
            break
        bands = 1 if same >= 1 else math.ceil(math.log(MISSED) / math.log(1 - same))
        if bands <= min(BANDS, COORDINATES // rows):
            best = rows, bands
    if best is None:
        bands = math.ceil(math.log(MISSED) / math.log(1 - percent / 100)) if percent > 0 else COORDINATES + 1
        if bands > COORDINATES:
            raise ValueError(f"{percent} percent needs more than {COORDINATES} coordinates to miss at most {MISSED} of the links")
        best = 1, bands
    return best


# ------------------------------------------------------------- sets and sketches
def shingle_sets(block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, ascending, and n + 1 offsets."""
    w = words(block)
    counts = w.counts
    value, at = grams(w.hashes, w.bounds, k)
    row = np.searchsorted(w.bounds, at, side="right") - 1
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):  # the whole sequence as one
        short = []
        for i in few:
            h = np.uint64(counts[i])
            for x in w.hashes[w.bounds[i] : w.bounds[i + 1]]:
                h = mix64(np.array([h ^ x], np.uint64))[0]
            short.append(h)
        value, row = np.concatenate([value, np.array(short, np.uint64)]), np.concatenate([row, few])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(block.n + 1))


def sketches(value: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """n x t coordinates (texts without elements keep the largest value)."""
    n = len(bounds) - 1
    flat = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(n), sizes)
    live_value, live_row, most = value, row, int(sizes.max(initial=0))
    for i in range(2 * t):
        if len(live_value) == 0:
            break
        h = mix64(live_value ^ np.uint64((0xA076 * (i + 1)) << 20))
        places = (h >> np.uint64(32)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        coordinate = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, live_row * t + places.astype(np.int64), coordinate)
        if (i + 1) * most >= t and (i < 8 or i % 8 == 0):
            open_ = np.zeros(n, bool)
            there = np.unique(live_row)
            open_[there] = (flat.reshape(n, t)[there] == np.iinfo(np.uint64).max).any(axis=1)
            on = open_[live_row]
            live_value, live_row = live_value[on], live_row[on]
            most = int(np.bincount(live_row).max(initial=0))
    return flat.reshape(n, t)


def digest_of(value: np.ndarray) -> bytes | None:
    return hashlib.blake2b(value.tobytes(), digest_size=16).digest() if len(value) else None


def prepare(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest (null without shingles), buckets."""
    rows, bands = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            for block in blocks(batch.column(1), limit=BLOCK_BYTES, rows=BLOCK_TEXTS):
                value, bounds = shingle_sets(block, shingle)
                coordinates = sketches(value, bounds)
                bucket = np.zeros((block.n, bands), np.uint64)
                for b in range(bands):
                    h = np.full(block.n, b + 1, np.uint64)
                    for j in range(b * rows, (b + 1) * rows):
                        h = mix64(h ^ coordinates[:, j])
                    bucket[:, b] = h
                sizes = np.diff(bounds)
                digest = [digest_of(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.slice(block.first, block.n),
                        pa.array(sizes, pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * bands, pa.int32()), pa.array(bucket.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "digest", "buckets"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, buckets array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, set (ascending 64-bit shingle hashes); a row per different text of an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), limit=BLOCK_BYTES, rows=BLOCK_TEXTS):
                value, bounds = shingle_sets(block, shingle)
                sets = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(sets, pa.binary())], names=["id", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, set binary")
    return rows.filter("length(set) > 0").dropDuplicates(["id", "set"])


# ------------------------------------------------------------------ verification
def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    x = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("set_u")), "u")
    x = x.join(sets.select(F.col("id").alias("v"), F.col("set").alias("set_v")), "v")
    return x.select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long")


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_forest(labels: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest (pairs of places) of the links between members of
    different labels; with ``sides`` only pairs over both sides count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (int(sizes.sum()) - both) else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    common = np.zeros((n, n), np.float32)
    renamed = np.full(len(count), -1)
    renamed[shared] = np.arange(len(shared))
    column = renamed[column]
    for first in range(0, len(shared), BLOCK_COLUMNS):
        here = (column >= first) & (column < first + BLOCK_COLUMNS)
        part = np.zeros((n, min(BLOCK_COLUMNS, len(shared) - first)), np.float32)
        part[owner[here], column[here] - first] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = (100 * common.astype(np.float64) >= percent * union) & (labels[:, None] != labels[None, :])
    if sides is not None:
        linked &= sides[:, None] != sides[None, :]
    parent = list(range(n))
    leader: dict[int, int] = {}
    for i, g in enumerate(labels.tolist()):
        parent[i] = leader.setdefault(g, i)
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1)))):
        a, b = _root(parent, i), _root(parent, j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _forests(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members(bucket, id, label) of open buckets -> links (u, v).

    In each bucket the largest label's members stand on one side, all others on the
    other. Each side is dealt to blocks; a row group is a block of the first with a
    block of the second, or two blocks (or one) of the second. The largest label's
    rows are so repeated once per block of the others, and not compared among
    themselves."""
    by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    top = by_label.groupBy("bucket").agg(F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("top"))
    ceil = lambda c: F.ceil(c / BLOCK_MEMBERS).cast("int")
    x = members.join(top, "bucket").select(
        "bucket", "id", "label",
        (F.col("label") == F.col("top.label")).alias("main"),
        ceil(F.col("top.n")).alias("left"),
        ceil(F.col("m") - F.col("top.n")).alias("right"),
    )
    x = x.withColumn("block", F.pmod(F.xxhash64("id", "bucket"), F.when(F.col("main"), F.col("left")).otherwise(F.col("right"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    # cells: (-1 - block of the largest label, block of the others) or (block, block) of the others
    for_main = F.transform(upto(F.col("right")), lambda o: cell(-1 - F.col("block"), o))
    for_rest = F.concat(
        F.transform(upto(F.col("left")), lambda o: cell(-1 - o, F.col("block"))),
        F.transform(upto(F.col("right")), lambda o: cell(F.least(F.col("block"), o), F.greatest(F.col("block"), o))),
    )
    x = x.withColumn("cell", F.explode(F.when(F.col("main"), for_main).otherwise(for_rest)))
    # a cell of one label has no pair to compare
    x = x.select("bucket", "cell.i", "cell.j", "id", "label", F.when(F.col("main"), -1).otherwise(F.col("block")).alias("side"))
    busy = x.groupBy("bucket", "i", "j").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").drop("a", "b")
    x = x.join(busy, ["bucket", "i", "j"]).join(sets, "id").select("bucket", "i", "j", "id", "label", "side", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in runs(batches, 3):
            labels = np.asarray(rows["label"].combine_chunks().dictionary_encode().indices)
            sets_ = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows["set"]]
            links = link_forest(labels, sets_, np.asarray(rows["side"]) if i != j else None, percent)
            if links:
                u, v = (pa.array(k, pa.int64()) for k in zip(*links))
                ids = rows["id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(u), ids.take(v)], names=["u", "v"])

    key = ["bucket", "i", "j"]
    return x.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long")


# ------------------------------------------------------------------ the operator
def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    folder = run_folder(spark, "near")
    prepared = written(prepare(docs, shingle, percent), f"{folder}/prepared")
    known = prepared.filter("doc_id is not null and digest is not null")
    class_of = known.groupBy("digest").agg(F.min("doc_id").alias("id"))
    # one row of each class carries its buckets; equal sets have equal buckets
    lead = known.join(class_of, "digest").filter("doc_id = id").dropDuplicates(["digest"])
    entries = lead.select("id", F.posexplode("buckets").alias("band", "hash")).select("id", F.xxhash64("band", "hash").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    members = written(entries.join(shared.select("bucket", "first"), "bucket"), f"{folder}/members")

    pairs = members.groupBy("id").agg(F.min("first").alias("v")).filter("id > v").select(F.col("id").alias("u"), "v")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = written(full_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), shingle), f"{folder}/sets")
    direct = written(_verified(pairs, sets, percent), f"{folder}/direct")
    label = components(direct)

    labelled = members.select("bucket", "id").join(label, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label"))
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("bucket")
    rest = written(labelled.join(open_, "bucket"), f"{folder}/open")
    more = written(_forests(rest, sets, percent), f"{folder}/more")

    # rows of one doc_id are one node, linked with the classes of all its texts
    own = known.join(class_of, "digest").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    final = components(direct.union(more).union(own)).withColumnRenamed("id", "doc_id")
    out = prepared.join(final, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
