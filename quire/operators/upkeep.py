"""Keeping the index current: replace a book's fragments when its content
changes (T8), drop them with the book (T10), empty the corpus (S11).

The relational core is an anti-join on the changed ids plus a union of the
re-analysed books. A written index takes a batch as a further version: the changed
books' rows, the ids of changed and deleted books, and a marker that makes them
visible together (see ``quire.plans.index``).
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.analyze import fragments
from quire.plans.index import BOOK_FIELDS, CHANGED_SCHEMA, DEFAULT_BUCKETS, FILES_COLUMNS, FILES_SCHEMA, TextIndex, bucket_of, commit, committed, read_versions, write_version
from quire.session import require_checkpoint_dir
from quire.sources.books import shared_path


def _twice() -> Column:
    message = F.concat(F.lit("two versions of one book and no order_col: file_id "), F.coalesce(F.col("file_id").cast("string"), F.lit("null")))
    return F.raise_error(message).cast("long")


def pinned_versions(changes: DataFrame, order_col: str | None) -> DataFrame:
    """``latest_versions`` pinned by a reliable checkpoint. Without an order only the ids
    are counted, on the pinned rows: the texts are neither shuffled nor sorted for it."""
    if order_col is not None:
        return latest_versions(changes, order_col).select(*FILES_COLUMNS).checkpoint(eager=True)
    changes = changes.select(*FILES_COLUMNS).checkpoint(eager=True)
    changes.groupBy("file_id").agg(F.count("*").alias("_v")).filter("_v > 1").select(_twice().alias("file_id")).head(1)
    return changes


def latest_versions(changes: DataFrame, order_col: str | None) -> DataFrame:
    """One row per ``file_id``: the newest by ``order_col``. Without an order two
    versions of one book cannot be told apart, so a second one fails the job."""
    book = Window.partitionBy("file_id")
    if order_col is None:
        x = changes.withColumn("_v", F.count("*").over(book))
        return x.withColumn("file_id", F.when(F.col("_v") > 1, _twice()).otherwise(F.col("file_id"))).drop("_v")
    return changes.withColumn("_v", F.row_number().over(book.orderBy(F.col(order_col).desc()))).filter("_v = 1").drop("_v")


def upsert(index: TextIndex, changes: DataFrame, order_col: str | None = None) -> TextIndex:
    """T8 (lazy): books in ``changes(file_id, filename, title, author, content)``
    replace their old rows; others are untouched."""
    changes = latest_versions(changes, order_col).select("file_id", "filename", "title", "author", "content")
    ids = changes.select("file_id")
    files = index.files.select(*changes.columns).join(ids, "file_id", "left_anti").unionByName(changes)
    fresh = fragments(changes, index.max_tokens, index.config, keep=BOOK_FIELDS)
    frags = index.fragments.select(*fresh.columns).join(ids, "file_id", "left_anti").unionByName(fresh)
    return TextIndex(files, frags, None, index.config, index.max_tokens)


def delete(index: TextIndex, deleted_ids: DataFrame) -> TextIndex:
    """T10 (lazy): drop books and, by cascade, their fragments."""
    ids = deleted_ids.select("file_id")
    return TextIndex(
        index.files.join(ids, "file_id", "left_anti"),
        index.fragments.join(ids, "file_id", "left_anti"),
        None,
        index.config,
        index.max_tokens,
    )


def clear(index: TextIndex) -> TextIndex:
    """An empty corpus with the same schemas."""
    return TextIndex(index.files.limit(0), index.fragments.limit(0), None, index.config, index.max_tokens)


# --- written index ------------------------------------------------------------
TRIES = 10  # versions that other writers may take before this one


def _committed_once(spark: SparkSession, path: str, write: Callable[[TextIndex, int, str], int]) -> None:
    """``write(index, version, writer)`` writes a version of the newest index and gives
    its base. If another writer commits that version first, its rows are never shown, and
    it is written again on top of the other's."""
    for k in range(TRIES):
        now = TextIndex.load(spark, path)
        version, writer = now.version + 1, uuid.uuid4().hex
        base = write(now, version, writer)
        if commit(spark, path, version, base, writer):
            return
        time.sleep(0.1 * 2**k)  # the other marker's content may still be on its way
    raise RuntimeError(f"{TRIES} versions of {path} were committed by other writers meanwhile")


def kinds_of_change(index: TextIndex, changes: DataFrame) -> DataFrame:
    """``(file_id, kind)`` of ``changes``: ``new`` book, changed ``text``, changed ``fields``
    only, or the ``same``. Texts are compared by digest (they do not travel); on the path layout only the buckets of
    the changed books are read."""
    rows = index.files
    on = ["file_id"]
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    new = changes.select("file_id", F.struct("filename", "title", "author").alias("_new"), digest("content").alias("_text"))
    if "bucket" in rows.columns:
        on, new = ["bucket", "file_id"], new.withColumn("bucket", bucket_of("file_id", index.buckets))
    old = rows.select(*on, F.struct("filename", "title", "author").alias("_fields"), digest("content").alias("_digest"))
    kind = (
        F.when(F.col("_digest").isNull(), "new")
        .when(F.col("_digest") != F.col("_text"), "text")
        .when(F.col("_new") != F.col("_fields"), "fields")
        .otherwise("same")
    )
    return new.join(old, on, "left").select("file_id", kind.alias("kind"))


def apply_changes(
    index: TextIndex, path: str, changes: DataFrame | None = None, deleted_ids: DataFrame | None = None,
    order_col: str | None = None,
) -> TextIndex:
    """T8/T10 on a written index: append a version that holds the changed books and
    names them and the deleted ones. What is written grows with the batch, not with
    the index: the batch's books are analysed from their texts (the index's fragments are not
    read); books of which only other fields changed keep their postings; a book that is the
    same is not written. Writers at the same time take turns
    (no change is lost; of one book, the version committed last counts). Returns the
    reloaded index."""
    spark = index.spark
    require_checkpoint_dir(spark)
    if changes is None and deleted_ids is None:
        return index
    # Inputs are pinned by a reliable checkpoint (bounded by the batch): they may be
    # derived from the index itself, and are read several times.
    if changes is None:
        changes = spark.createDataFrame([], FILES_SCHEMA)
    changes = pinned_versions(changes, order_col)
    if deleted_ids is not None:
        deleted_ids = deleted_ids.select(F.col("file_id").cast("long").alias("file_id")).distinct().checkpoint(eager=True)
        changes = changes.join(deleted_ids, "file_id", "left_anti")

    def write(now: TextIndex, version: int, writer: str) -> int:
        # what is read back is a table of known size, which Spark may send to the texts
        judged = shared_path(spark, "quire-kinds")
        kinds_of_change(now, changes).write.parquet(judged)
        kinds = spark.read.schema("file_id long, kind string").parquet(judged)
        rows = changes.join(kinds.filter("kind = 'same'").select("file_id"), "file_id", "left_anti")
        ids = kinds.filter("kind <> 'same'").select("file_id", (F.col("kind") != "fields").alias("text"))
        if deleted_ids is not None:
            ids = ids.unionByName(deleted_ids.withColumn("text", F.lit(True)))
        ids.write.mode("overwrite").parquet(os.path.join(path, "changed", f"version={version}", f"writer={writer}"))
        # the ids read back are a table of known size, which Spark may send to the fragments
        kept = read_versions(spark, path, "changed", CHANGED_SCHEMA, [(version, writer)]).filter("NOT text").select("file_id")
        write_version(spark, path, version, writer, rows, now.config, now.max_tokens, now.buckets, kept=kept)
        return committed(spark, path)[0][0]

    _committed_once(spark, path, write)
    return TextIndex.load(spark, path, index.config, index.max_tokens)


def compact(index: TextIndex, path: str) -> TextIndex:
    """Fold all versions into a new base, the only one that later loads read. The files
    of older versions may be deleted when no loaded index shows them any more."""

    def write(now: TextIndex, version: int, writer: str) -> int:
        write_version(index.spark, path, version, writer, now.files, now.config, now.max_tokens, now.buckets)
        return version

    _committed_once(index.spark, path, write)
    return TextIndex.load(index.spark, path, index.config, index.max_tokens)


def empty(index: TextIndex, path: str) -> TextIndex:
    """S11 on a written index: a version that deletes every book, folded into an empty base."""
    return compact(apply_changes(index, path, deleted_ids=index.files.select("file_id")), path)


__all__ = ["upsert", "delete", "clear", "apply_changes", "compact", "empty", "kinds_of_change", "latest_versions", "DEFAULT_BUCKETS"]
