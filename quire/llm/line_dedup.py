"""Line dedup by winnowing: later copies of repeated runs of lines are deleted.

A line counts if it has a word. Around every line stand two windows: from it on,
the fewest lines that hold ``min_words`` words, and up to it, the same backwards.

1. Winnowing: each window selects the smallest of its line hashes (the first of equal
   ones). Any run of ``min_words`` words or more holds a whole window on either side, so
   equal runs always share selected fingerprints. A window that selects the same place
   as its neighbour adds nothing: about one line of a window is a fingerprint.
2. Join: only the fingerprints travel; those of two places or more are seeds.
3. Extension, in documents with a seed only: a seed is extended both ways to the windows
   that selected it, whole lines by a 128-bit digest. Equal windows are grouped by a
   min-aggregation, and all but the first (by doc_id, then place) are later copies.
   Windows overlap line by line, so the union of a run's windows is the run, extended as
   far as it agrees: a line goes exactly if it lies in a run of ``min_words`` words or
   more that stands somewhere earlier as well.
4. The lines of later copies are cut out of the text; all other lines stay.

No pairs are made: an occurrence is compared with the first of its group only, by an
aggregation (combined before the shuffle) and a join in which a hot group's rows may
be split. Only DataFrame functions.

Cases: null text: stays null, no lines. Blank lines are never deleted and do not
part a run. Null doc_id: before all others. Rows equal in doc_id and text are one
document (each row gets the same result). Runs that repeat within one document count
too. Empty table: empty result. Extra columns are ignored by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import run_folder, written

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _windows(min_words: int):
    """A document's lines, and the windows from a line on and up to it."""
    doc = Window.partitionBy("doc")
    return doc, doc.orderBy("start").rangeBetween(0, min_words - 1), doc.orderBy("end").rangeBetween(1 - min_words, 0)


def placed_lines(keyed: DataFrame, min_words: int) -> DataFrame:
    """Lines with words of ``keyed(doc, doc_id, text)``: digest, word offsets, whether the
    text has enough words for a window from the line on (``fore``) and up to it (``aft``),
    and the fingerprint that this window selects, where the window before it on that side
    selected another one (``pick_a``, ``pick_b``: digest and place)."""
    lines = keyed.select("doc", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    digest = F.unhex(F.md5(F.col("line").cast("binary")))
    lines = lines.select("doc", "doc_id", "pos", digest.alias("digest"), F.regexp_count("line", F.lit(WORD)).alias("n")).filter("n > 0")
    one = lines.repartition("doc").dropDuplicates(["doc", "pos"])
    doc, ahead, back = _windows(min_words)
    start = F.coalesce(F.sum("n").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("start", start).withColumn("end", F.col("start") + F.col("n")).withColumn("total", F.sum("n").over(doc))
    # a line of min_words is the same window on both sides
    one = one.withColumn("fore", F.col("total") - F.col("start") >= min_words).withColumn("aft", (F.col("end") >= min_words) & (F.col("n") < min_words))
    for side, whole, window, order in (("a", "fore", ahead, "start"), ("b", "aft", back, "end")):
        one = one.withColumn(f"pick_{side}", F.when(F.col(whole), F.min(F.struct("digest", "pos")).over(window)))
        # places selected never go back, so equal ones follow each other
        before = F.lag(f"pick_{side}.pos").over(doc.orderBy(order))
        one = one.withColumn(f"new_{side}", ~F.col(f"pick_{side}.pos").eqNullSafe(before))
    picks = [F.when(F.col(f"new_{x}"), F.col(f"pick_{x}")).alias(f"pick_{x}") for x in "ab"]
    return one.select("doc", "doc_id", "pos", "digest", "n", "start", "end", "fore", "aft", *picks)


def fingerprints(placed: DataFrame) -> DataFrame:
    """(print, doc, pos) of the selected lines; a place may come once for each side."""
    picks = placed.filter("pick_a is not null or pick_b is not null").select("doc", F.explode_outer(F.array("pick_a", "pick_b")).alias("p"))
    return picks.filter("p is not null").select(F.col("p.digest").alias("print"), "doc", F.col("p.pos").alias("pos"))


def seeds(prints: DataFrame) -> DataFrame:
    """(doc, pos) of the fingerprints that stand in two places or more."""
    at = F.xxhash64("doc", "pos")
    shared = prints.groupBy("print").agg(F.min(at).alias("x"), F.max(at).alias("y")).filter("x < y").select("print")
    return prints.join(shared, "print").select("doc", "pos").distinct()


def extended(placed: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Lines of the documents with a seed; ``lines_a`` and ``lines_b``: digest of the whole
    window on that side if a seed is its fingerprint."""
    lines = placed.select("doc", "doc_id", "pos", "digest", "n", "start", "end", "fore", "aft", F.lit(0).alias("seed"))
    both = lines.unionByName(found.select("doc", "pos", F.lit(1).alias("seed")), allowMissingColumns=True)
    doc, ahead, back = _windows(min_words)
    here = doc.orderBy("pos").rangeBetween(0, 0)
    near = both.withColumn("any", F.max("seed").over(doc)).filter("any = 1").withColumn("seed", F.max("seed").over(here)).filter("digest is not null")

    def window(whole: str, w):
        hexed = F.array_join(F.transform(F.collect_list("digest").over(w), F.hex), "")
        seeded = F.min(F.struct("digest", "pos", "seed")).over(w)["seed"] == 1
        return F.when(F.col(whole) & seeded, F.unhex(F.md5(hexed.cast("binary"))))

    return near.select("doc", "doc_id", "pos", "n", "start", "end", window("fore", ahead).alias("lines_a"), window("aft", back).alias("lines_b"))


def repeated_lines(keyed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, pos, n) of the lines to delete."""
    spark = keyed.sparkSession
    placed = written(placed_lines(keyed, min_words), run_folder(spark, "lines"))
    found = seeds(fingerprints(placed))
    lines = written(extended(placed, found, min_words), run_folder(spark, "line-windows"))

    def side(x: str) -> DataFrame:
        own = lines.filter(F.col(f"lines_{x}").isNotNull())
        return own.select(F.lit(x).alias("side"), F.col(f"lines_{x}").alias("lines"), F.struct("doc_id", "doc", "pos").alias("place"), "start", "end")

    windows = side("a").union(side("b"))
    first = windows.groupBy("side", "lines").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first <> last").drop("last")
    later = windows.join(first, ["side", "lines"]).filter(~F.col("place").eqNullSafe(F.col("first")))
    marks = later.select(F.col("place.doc").alias("doc"), "start", "end", *[(F.col("side") == x).cast("int").alias(x) for x in "ab"])
    # lines and marks meet by document; a mark reaches the lines of its window
    marked = lines.select("doc", "pos", "n", "start", "end").unionByName(marks, allowMissingColumns=True)
    doc = Window.partitionBy("doc")
    under_a = F.max("a").over(doc.orderBy("start").rangeBetween(1 - min_words, 0))
    under_b = F.max("b").over(doc.orderBy("end").rangeBetween(0, min_words - 1))
    return marked.withColumn("gone", F.greatest(under_a, under_b)).filter("pos is not null and gone = 1").select("doc", "pos", "n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, removed_lines, removed_words, text (what stays)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.xxhash64("doc_id", "text"))
    gone = repeated_lines(keyed, min_words).groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("cut"), F.count("*").alias("removed_lines"), F.sum("n").alias("removed_words"))
    out = keyed.join(gone, "doc", "left").withColumn("lines", F.split("text", "\n"))
    ends = F.concat(F.array(F.lit(-1)), F.col("cut"), F.array(F.size("lines")))
    out = out.withColumn("ends", ends)
    part = lambda k: F.slice("lines", F.get("ends", k) + 2, F.get("ends", k + 1) - F.get("ends", k) - 1)
    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("cut")), part)), "\n")
    return out.select(
        "doc_id",
        F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
        F.when(F.col("cut").isNull(), F.col("text")).otherwise(left).alias("text"),
    )
