"""Connected components of a link table, by large-star / small-star rounds.

Every round is two min-aggregations and joins on the link table; nothing is
collected but one line of totals that says whether a round changed anything, and
each round's links are written to the shared folder (no growing lineage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import run_folder, written


def _star(both: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, the node itself included."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> ``(id, component)`` for every linked id; the component is
    its smallest id. Null ends, self-links and repeated links do not matter."""
    folder = run_folder(links.sparkSession, "components")
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen, k = written(edges, f"{folder}/0"), None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_star(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u > v")
        low = _star(down)
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        k += 1
        edges = written(small.filter("u <> v").distinct(), f"{folder}/{k}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
