"""Centroid clustering by an incremental matrix of exact dot products.

Every vector becomes integers, ``floor(SCALE * x)`` by component. Its row holds its
integer dot product with each centroid; the products are written with the vector
after every round. When centroids move, a product changes by the vector's components
at the places where that centroid changed, times the change: a centroid that stays
costs nothing, one that moved in three components costs three multiplications. The
nearest centroid then comes from the products alone: ``|c|^2 - 2 v.c`` is least where
the squared distance is (``|v|^2`` is the same for all), the smaller number on ties.

All sums are integers, so the result does not depend on the order of rows or tasks. A
round is one pass of narrow tasks over the written rows (no shuffle) and one
aggregation of component sums by cluster, combined in the tasks: a row per task and
cluster is shuffled, however many vectors one cluster holds. The driver sees the
centroids (``clusters`` x ``dim`` numbers), never vectors. The rows of the round before
are deleted once the next are written. Rounds end early only if no centroid changed:
then nothing more can change.

Result, a row per kept vector: vec_id, cluster, distance (squared, to its final
centroid), cluster_inertia, inertia, centroid_sha256 (of the centroid's integers in
decimal, joined by commas).

Cases: a null embedding, one of another length, or one with a null, NaN or infinite
component: left out. Null vec_id: a vector like others, its hash that of the bare salt.
Repeated vec_ids: each row is a vector; among equal start hashes the smaller components
come first. Fewer vectors than clusters: as many centroids as vectors. Equal vectors or
centroids: the smaller cluster number. Components over ``LARGEST`` in size after
scaling: an error, since squared distances would not fit 64 bits. Empty table: empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import discard, run_folder, written

CLUSTERS = 8
ROUNDS = 10
DIM = 64
SCALE = 1024
SALT = "3"
LARGEST = 1 << 27  # 64 squares of differences of such numbers stay below 2**62

STATE = "vec_id long, q array<long>, dots array<long>, cluster int, distance long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the usable vectors of ``vectors(vec_id, embedding)`` as integers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    x = x.filter((F.size("e") == dim) & F.forall("e", finite))
    wide = F.raise_error(F.lit(f"an embedding has a component beyond {LARGEST // scale}; squared distances would not fit 64 bits"))
    fits = F.forall("e", lambda v: F.abs(v * scale) <= LARGEST)
    return x.select("vec_id", F.when(fits, F.transform("e", lambda v: F.floor(v * scale))).otherwise(wide.cast("array<long>")).alias("q"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The vectors of the smallest salted hashes of vec_id, in ascending order."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name.cast("binary"), 256), "q").limit(clusters).select("q").collect()
    return np.array([r.q for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(m: np.ndarray) -> pa.Array:
    n, width = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(m.reshape(-1), pa.int64()))


def updated(batches: Iterator[pa.RecordBatch], old: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with the products, clusters and distances of the centroids ``new``, from
    rows with the products of ``old`` (rows without products: those of zero centroids)."""
    change, dim = new - old, new.shape[1]
    moved = [(c, np.flatnonzero(change[c])) for c in range(len(new)) if change[c].any()]
    norms = (new * new).sum(axis=1)
    for batch in batches:
        q = _matrix(batch["q"], dim)
        dots = _matrix(batch["dots"], len(new)).copy() if "dots" in batch.schema.names else np.zeros((len(q), len(new)), np.int64)
        for c, at in moved:
            dots[:, c] += q[:, at] @ change[c, at]
        parts = norms - 2 * dots
        cluster = parts.argmin(axis=1)  # the first of equals
        distance = (q * q).sum(axis=1) + parts[np.arange(len(q)), cluster]
        columns = [batch["vec_id"], _lists(q), _lists(dots), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "q", "dots", "cluster", "distance"])


def moved_centroids(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Each cluster's componentwise floor of sum over count; empty clusters stay."""
    sums = [F.sum(F.element_at("q", j + 1)).alias(f"s{j}") for j in range(now.shape[1])]
    out = now.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row per cluster
        out[row.cluster] = [row[f"s{j}"] // row.n for j in range(now.shape[1])]
    return out


def centroid_clusters(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT
) -> DataFrame:
    """Cluster ``vectors(vec_id, embedding)``; columns as in the module's text."""
    spark = vectors.sparkSession
    folder = run_folder(spark, "centroids")
    state = written(integer_vectors(vectors, dim, scale), path := f"{folder}/vectors")
    new = first_centroids(state, clusters, salt)
    if len(new) == 0:
        return spark.createDataFrame([], RESULT)
    old = np.zeros_like(new)
    for k in range(rounds + 1):
        step = state.mapInArrow(lambda b, old=old, new=new: updated(b, old, new), STATE)
        before, path = path, f"{folder}/{k}"
        state = written(step, path)
        discard(spark, before)
        old, new = new, moved_centroids(state, new) if k < rounds else new
        if (old == new).all():
            break
    inertia = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    listed = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in old]
    return state.select(
        "vec_id",
        "cluster",
        "distance",
        listed([inertia.get(c, 0) for c in range(len(old))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        listed(digests).alias("centroid_sha256"),
    )
