"""A feed of typed changes keeps a written index current.

An event is ``(op, file_id, seq, filename, title, author, content)``: ``insert`` and
``update`` put the book as it is given (whether or not the index holds it), ``delete``
is a tombstone and needs no fields. ``seq`` orders the events of a book, whichever
order they arrive in: an event counts only if its number is beyond all that were
applied to the book before, in this batch or an earlier one, so that a late older
update neither undoes a newer one nor brings a deleted book back.

What was applied is kept beside the index (``events_applied``: book, number, op by feed,
batch and bucket). A batch looks up its own books only, by bucket, and leaves out what it
wrote itself, so a batch replayed after a failure applies the same events once more with
the same result. One feed at a time writes to an index.

Cases: events without a known op, an id, a number, or a text where a book is put, are
written to ``events_rejected`` (or raise with ``strict``). Of two events of a book with
one number the delete counts, else the one with the greater text and fields; one that
comes in a later batch is ignored. Repeated events count once. An empty batch changes
nothing. Extra columns of the files are not read.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.text import DEFAULT_MAX_TOKENS
from quire.operators.upkeep import apply_changes
from quire.plans.index import DEFAULT_BUCKETS, TextIndex, bucket_of

FIELDS = ("filename", "title", "author", "content")
EVENT_SCHEMA = "op string, file_id long, seq long, filename string, title string, author string, content string"
APPLIED_SCHEMA = "file_id long, seq long, op string, feed string, epoch long, bucket int"


def is_event() -> Column:
    """Whether a row says what to do with which book, and when."""
    puts = F.col("op").isin("insert", "update") & F.col("content").isNotNull()
    return F.coalesce(((F.col("op") == "delete") | puts) & F.col("file_id").isNotNull() & F.col("seq").isNotNull(), F.lit(False))


def newest_events(events: DataFrame) -> DataFrame:
    """The event of each book that counts: the largest number, a delete before others."""
    rank = [F.col("seq").desc(), (F.col("op") == "delete").desc(), *[F.col(c).desc() for c in reversed(FIELDS)]]
    w = Window.partitionBy("file_id").orderBy(*rank)
    return events.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def applied_events(spark: SparkSession, index_path: str) -> DataFrame:
    """Book, number and op of every event that was applied to the index."""
    path = os.path.join(index_path, "events_applied")
    none = spark.createDataFrame([], APPLIED_SCHEMA)
    none.write.mode("ignore").partitionBy("feed", "epoch", "bucket").parquet(path)
    return spark.read.schema(APPLIED_SCHEMA).parquet(path)


def event_batches(
    index_path: str,
    feed: str = "feed",
    config: str = "simple",
    max_tokens: int = DEFAULT_MAX_TOKENS,
    buckets: int = DEFAULT_BUCKETS,
    strict: bool = False,
):
    """``foreachBatch`` function that applies a micro-batch of events to the index at
    ``index_path`` (made if it is not there). ``feed`` names the feed's own batch numbers."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        if not TextIndex.exists(spark, index_path):
            TextIndex.create_empty(spark, index_path, config, max_tokens, buckets)
        index = TextIndex.load(spark, index_path, config, max_tokens)
        sent = batch.select("op", "file_id", "seq", *FIELDS)
        here = os.path.join(f"feed={feed}", f"epoch={epoch_id}")
        rejected = sent.filter(~is_event())
        if strict and not rejected.isEmpty():
            raise ValueError(f"batch {epoch_id} holds events without a known op, an id, a number or a text")
        rejected.write.mode("overwrite").parquet(os.path.join(index_path, "events_rejected", here))

        newest = newest_events(sent.filter(is_event())).withColumn("bucket", bucket_of("file_id", index.buckets))
        newest = newest.checkpoint(eager=True)
        before = applied_events(spark, index_path).filter((F.col("feed") != feed) | (F.col("epoch") < epoch_id))
        last = before.join(newest.select("bucket", "file_id"), ["bucket", "file_id"]).groupBy("file_id").agg(F.max("seq").alias("last"))
        due = newest.join(last, "file_id", "left").filter("last IS NULL OR seq > last").checkpoint(eager=True)
        applied = due.select("file_id", "seq", "op", "bucket")
        applied.write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(index_path, "events_applied", here))
        gone = F.col("op") == "delete"
        apply_changes(index, index_path, due.filter(~gone).select("file_id", *FIELDS), due.filter(gone).select("file_id"))

    return run


def start_change_feed(
    spark: SparkSession,
    source: str,
    index_path: str,
    checkpoint: str,
    fmt: str = "parquet",
    config: str = "simple",
    max_tokens: int = DEFAULT_MAX_TOKENS,
    buckets: int = DEFAULT_BUCKETS,
    strict: bool = False,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the feed over files of events (``EVENT_SCHEMA``) at ``source``; with
    ``available_now`` it processes what is there and stops."""
    reader = spark.readStream.schema(EVENT_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    feed = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    run = event_batches(index_path, feed, config, max_tokens, buckets, strict)
    writer = reader.load(source).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
