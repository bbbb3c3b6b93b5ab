"""Keep a written index current as book rows arrive (Structured Streaming).

A file source (Parquet rows of ``documents`` by default) feeds
``foreachBatch``; each micro-batch keeps the newest version of every book (by
``order_col``, else by file modification time, path and row in the file),
then appends them as a version of the index (``apply_changes``). A batch replayed
after a failure puts the same rows over the same books, so the sink is idempotent
and the checkpoint gives exactly-once results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.upkeep import apply_changes
from quire.plans.index import DEFAULT_BUCKETS, TextIndex
from quire.sources.books import file_path
from quire.sources.corpus import files_from_documents

# Columns that say which of two versions in a batch arrived later.
ARRIVAL = ("_arrived", "_from", "_row")
DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def upsert_batches(
    index_path: str,
    to_files: Callable[[DataFrame], DataFrame] = files_from_documents,
    order_col: str | None = None,
    config: str = "simple",
    max_tokens: int | None = None,
    key_col: str = "doc_id",
    buckets: int | None = None,
):
    """``foreachBatch`` function: upsert each micro-batch into the index at
    ``index_path``; the newest row per ``key_col`` wins, by ``order_col`` or by
    where the row came from (``ARRIVAL``)."""
    from quire.functions.text import DEFAULT_MAX_TOKENS

    tokens = DEFAULT_MAX_TOKENS if max_tokens is None else max_tokens

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        newest = [order_col] if order_col is not None else [c for c in ARRIVAL if c in batch.columns]
        if newest:
            w = Window.partitionBy(key_col).orderBy(*[F.col(c).desc() for c in newest])
            batch = batch.withColumn("_v", F.row_number().over(w)).filter("_v = 1").drop("_v", *ARRIVAL)
        if not TextIndex.exists(spark, index_path):
            TextIndex.create_empty(spark, index_path, config, tokens, buckets or DEFAULT_BUCKETS)
        index = TextIndex.load(spark, index_path, config, tokens)
        apply_changes(index, index_path, changes=to_files(batch))

    return run


def start_index_feed(
    spark: SparkSession,
    source: str,
    index_path: str,
    checkpoint: str,
    schema: str = DOCUMENT_SCHEMA,
    fmt: str = "parquet",
    to_files: Callable[[DataFrame], DataFrame] = files_from_documents,
    order_col: str | None = None,
    config: str = "simple",
    max_tokens: int | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    buckets: int | None = None,
) -> StreamingQuery:
    """Start the feed; ``available_now`` processes what is there and stops.
    ``buckets`` sizes a new index. Call ``compact`` now and then: every version
    since the last is joined out of each read."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(source)
    if order_col is None:
        row = F.col("_metadata.row_index") if fmt == "parquet" else F.lit(0)
        stream = stream.select("*", F.col("_metadata.file_modification_time").alias("_arrived"), F.col("_metadata.file_path").alias("_from"), row.alias("_row"))
    run = upsert_batches(index_path, to_files, order_col, config, max_tokens, buckets=buckets)
    writer = stream.writeStream.foreachBatch(run)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def book_batches(
    index_path: str,
    config: str = "simple",
    max_tokens: int | None = None,
    buckets: int | None = None,
    strict: bool = False,
):
    """``foreachBatch`` function for raw book files ``(path, mtime, value)``:
    parse (strict parser), keep the newest delivery of each file name, reuse the
    id of a known file name and number new ones after the largest id, then append
    them as a version. Rejected files go to
    ``<index_path>/_rejects/epoch=<batch>`` (or raise with ``strict``). Every
    step is idempotent, so a replayed batch leaves the same index."""
    from quire.functions.text import DEFAULT_MAX_TOKENS
    from quire.sources.books import assign_file_ids, parse_books

    tokens = DEFAULT_MAX_TOKENS if max_tokens is None else max_tokens

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy("_name").orderBy(F.col("mtime").desc(), F.col("path").desc())
        latest = (
            batch.withColumn("_name", F.element_at(F.split("path", "/"), -1))
            .withColumn("_v", F.row_number().over(w))
            .filter("_v = 1")
            .select("path", "value")
        )
        books, rejects = parse_books(latest, strict=strict)
        # one folder per epoch, overwritten: a replayed batch writes the same rows once
        rejects.write.mode("overwrite").parquet(f"{index_path}/_rejects/epoch={epoch_id}")
        if not TextIndex.exists(spark, index_path):
            TextIndex.create_empty(spark, index_path, config, tokens, buckets or DEFAULT_BUCKETS)
        index = TextIndex.load(spark, index_path, config, tokens)
        changes = assign_file_ids(books, index.files, reuse=True)
        apply_changes(index, index_path, changes=changes)

    return run


def start_book_feed(
    spark: SparkSession,
    directory: str,
    index_path: str,
    checkpoint: str,
    glob: str = "*.txt",
    config: str = "simple",
    max_tokens: int | None = None,
    buckets: int | None = None,
    strict: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """S1/S4/S5/S9 + T8 as files arrive: each new book file under ``directory``
    (a path or glob) is read whole, parsed and upserted into the index. A file
    source reads every path once, so a new version of a book arrives under a new
    path with the same file name (e.g. a new drop folder) and keeps its id."""
    stream = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("pathGlobFilter", glob)
        .load(directory)
        .select(
            file_path().alias("path"),
            F.col("_metadata.file_modification_time").alias("mtime"),
            "value",
        )
    )
    writer = stream.writeStream.foreachBatch(book_batches(index_path, config, max_tokens, buckets, strict))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
