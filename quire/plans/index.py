"""The text index: ``files``, ``fragments``, ``postings`` and ``lexicon`` tables.

Postings are position lists: a row per lexeme and fragment with the ascending positions
(``TextIndex.lists``; ``TextIndex.postings`` shows a row per occurrence). The lexicon has
the number of fragments of each lexeme: a search reads the lists of its rarest required
words first and, where that pays, filters the others by their fragments or books while
they are scanned (``TextIndex.match_lists``).

Three forms, one API (``TextIndex``):

* lazy - built from a ``files`` frame, re-derived by every read (the registered
  queries use it, so their work grows with the input);
* path layout (``write`` / ``load``) - all three tables partitioned by ``version`` and
  ``bucket = pmod(file_id, buckets)``: one book's rows share a directory
  (partition pruning for single-book reads and for selective results). Upkeep appends
  a version with the changed books only; a row counts if no later version names its
  book. A writer's rows lie under a folder of its own (``writer``), and one marker per
  version in ``_commits``, which only one writer can make, shows the rows of that writer
  in all tables together, to indexes loaded after it; ``compact`` folds versions into one;
* catalog tables (``write_tables`` / ``load_tables`` / ``attach_tables``) - all
  three bucketed by ``file_id`` into the same number of buckets, so searches
  run co-located, without shuffles.

In both written forms postings are sorted by lexeme inside each file (which holds some
books of a bucket), so Parquet statistics skip row groups and pages for ``lexeme IN (...)``; dictionaries and bloom
filters skip files whose range covers a word that they do not hold.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import DEFAULT_MAX_TOKENS
from quire.operators.analyze import check_config, fragments, lexicon, occurrences, position_lists
from quire.operators.query import Query, pivot

KEYS = ["file_id", "sequence_no"]
DEFAULT_BUCKETS = 64
# Buckets of the catalog-table layout (size to ~1-2 GB of postings per bucket).
DEFAULT_TABLE_BUCKETS = 64
FILES_COLUMNS = ["file_id", "filename", "title", "author", "content"]
# Book fields copied onto every fragment: result rows take them from the fragment
# rows they join anyway, instead of joining (and scanning) the files table.
BOOK_FIELDS = ("filename", "title", "author")
FRAGMENT_COLUMNS = [
    "file_id", "sequence_no", "content_array", "content_tsv", "content", "word_offset", "n_words", *BOOK_FIELDS,
]
FILES_SCHEMA = "file_id long, filename string, title string, author string, content string"
META_SCHEMA = "buckets int, config string, max_tokens int"
COMMIT_SCHEMA = "base long, writer string, version long"
# Books that a version replaces or deletes; text: their postings too.
CHANGED_SCHEMA = "file_id long, text boolean, version long, writer string"
OWN = ", version long, writer string"
# Schemas of the written tables (read with them, so an empty table still loads).
TABLE_SCHEMAS = {
    "files": FILES_SCHEMA + OWN + ", bucket int",
    "fragments": "file_id long, sequence_no int, content_array array<string>, "
    "content_tsv array<struct<lexeme:string,pos:int>>, content string, word_offset int, n_words int, "
    "filename string, title string, author string" + OWN + ", bucket int",
    "postings": "lexeme string, file_id long, sequence_no int, positions array<int>, word_offset int" + OWN + ", bucket int",
}
LEXICON_SCHEMA = "lexeme string, n_fragments long" + OWN
# Parquet options of written postings: words outside a file's dictionary pages are in a
# bloom filter, sized by the words that the file holds.
POSTINGS_OPTIONS = {"parquet.bloom.filter.enabled#lexeme": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
# Fragments of the rarest words that are sent to all executors (16 bytes each), by the lexicon's count.
SENT_FRAGMENTS = 200_000
# Bytes of text that one task analyses and writes.
TASK_TEXT = 8 << 20
# Bytes of written fragments of which one task makes postings, sorts and writes them.
TASK_FRAGMENTS = 32 << 20
SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
# The same in catalog tables, where each such task makes a file of its bucket.
TABLE_TASK_TEXT = 32 << 20
# The others are filtered when they stand in this many times more fragments.
PAYS = 4


def bucket_of(file_id, buckets: int = DEFAULT_BUCKETS) -> F.Column:
    return F.pmod(F.col(file_id) if isinstance(file_id, str) else file_id, F.lit(int(buckets))).cast("int")


def read_versions(spark: SparkSession, path: str, name: str, schema: str, versions: list[tuple[int, str]]) -> DataFrame:
    """The rows that the given (version, writer) pairs wrote; no other folder is looked at."""
    folder = os.path.join(path, name)
    paths = [os.path.join(folder, f"version={v}", f"writer={w}") for v, w in versions]
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths) if paths else spark.createDataFrame([], schema)


class TextIndex:
    """Files, fragments and (optionally materialised) postings of one corpus."""

    def __init__(
        self,
        files: DataFrame,
        frags: DataFrame,
        posts: DataFrame | None = None,
        config: str = "simple",
        max_tokens: int | None = DEFAULT_MAX_TOKENS,
        co_partitioned: bool = False,
        buckets: int = DEFAULT_BUCKETS,
        version: int = 0,
        words: DataFrame | None = None,
    ):
        self.files = files
        self.fragments = frags
        # written position lists and lexicon (none in a lazy index)
        self.lists = posts
        self.lexicon = words
        self._counts: dict[str, int] = {}
        self.config = check_config(config)
        self.max_tokens = max_tokens
        # True when all three tables are bucketed by file_id alike (catalog tables):
        # hits then need no shuffle, and per-book joins are co-located.
        self.co_partitioned = co_partitioned
        # number of bucket directories of the path layout
        self.buckets = int(buckets)
        # newest version of the path layout that this index shows
        self.version = int(version)

    def cache(self) -> "TextIndex":
        """Keep a lazy index's tables in executor memory (spilling to disk) for
        repeated searches in one session; ``unpersist`` releases them."""
        for df in (self.files, self.fragments, self.lists):
            if df is not None:
                df.persist()
        return self

    def unpersist(self) -> "TextIndex":
        for df in (self.files, self.fragments, self.lists):
            if df is not None:
                df.unpersist()
        return self

    @property
    def book_fields_on_fragments(self) -> bool:
        return all(c in self.fragments.columns for c in BOOK_FIELDS)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @classmethod
    def build(cls, files: DataFrame, max_tokens: int | None = DEFAULT_MAX_TOKENS, config: str = "simple") -> "TextIndex":
        """Lazy index over ``files`` (nothing runs until a read)."""
        return cls(files, fragments(files, max_tokens, config, keep=BOOK_FIELDS), None, config, max_tokens)

    @property
    def postings(self) -> DataFrame | None:
        """Written postings, a row per occurrence; None in a lazy index."""
        return None if self.lists is None else occurrences(self.lists)

    def hit_lists(self, lexemes: list[str], file_id: int | None = None) -> DataFrame:
        """Position lists ``(lexeme, file_id, sequence_no, positions, word_offset)`` of the
        given lexemes."""
        cols = ["lexeme", *KEYS, "positions", "word_offset"]
        if self.lists is None:
            return position_lists(self.fragment_rows(file_id), lexemes, self.config).select(*cols)
        p = self.lists
        if file_id is not None:
            if "bucket" in p.columns:  # path layout: prune the bucket directory
                p = p.filter(F.col("bucket") == file_id % self.buckets)
            p = p.filter(F.col("file_id") == file_id)  # bucketed tables prune buckets themselves
        return p.filter(F.col("lexeme").isin(sorted(set(lexemes)))).select(*cols)

    def hits(self, lexemes: list[str], file_id: int | None = None) -> DataFrame:
        """Posting rows ``(lexeme, file_id, sequence_no, pos, word_offset)`` of the given lexemes."""
        return occurrences(self.hit_lists(lexemes, file_id))

    def counts(self, lexemes: list[str]) -> dict[str, int] | None:
        """Fragments of each lexeme by the lexicon (versions added up, so never too few);
        None without a lexicon. One small read per new word, kept with the index."""
        if self.lexicon is None:
            return None
        new = sorted(set(lexemes) - set(self._counts))
        if new:
            rows = self.lexicon.filter(F.col("lexeme").isin(new)).groupBy("lexeme").agg(F.sum("n_fragments").alias("n")).collect()
            self._counts.update(dict.fromkeys(new, 0) | {r["lexeme"]: r["n"] for r in rows})
        return {w: self._counts[w] for w in lexemes}

    def match_lists(self, q: Query, file_id: int | None = None, by_book: bool = False) -> DataFrame:
        """The position lists that decide ``q``, rarest words first.

        Every matching fragment holds one of the query's pivot words (``pivot``). Where
        the other words stand in ``PAYS`` times more fragments, their lists are read only
        for the fragments (``by_book``: the books) of the pivot: a semi-join at the scan,
        before any shuffle, against keys that are broadcast when the lexicon bounds them
        by ``SENT_FRAGMENTS``; on the path layout it prunes bucket folders too. Rows of
        matching fragments (books) are the same as in ``hit_lists``."""
        counts = None if file_id is not None else self.counts(q.lexemes)
        found = None if counts is None else pivot(q.root, counts)
        if found is None:
            return self.hit_lists(q.lexemes, file_id)
        cost, words = found
        others = [w for w in q.lexemes if w not in words]
        if sum(counts[w] for w in others) < PAYS * cost or not others:
            return self.hit_lists(q.lexemes)
        keys = ["file_id"] if by_book else KEYS
        rare = self.hit_lists(sorted(words))
        where = rare.select(*keys).distinct()
        lists = self.lists.filter(F.col("lexeme").isin(others))
        if "bucket" in self.lists.columns:
            where, keys = where.withColumn("bucket", bucket_of("file_id", self.buckets)), ["bucket", *keys]
        if cost <= SENT_FRAGMENTS:
            where = F.broadcast(where)
        return rare.unionByName(lists.join(where, keys, "left_semi").select(*rare.columns))

    def fragment_rows(self, file_id: int | None = None) -> DataFrame:
        f = self.fragments
        if file_id is not None:
            if "bucket" in f.columns:
                f = f.filter(F.col("bucket") == file_id % self.buckets)
            f = f.filter(F.col("file_id") == file_id)
        return f

    def join_fragments(self, rows: DataFrame, cols: list[str], file_id: int | None = None) -> DataFrame:
        """``rows`` joined to the fragment columns ``cols`` on (file_id, sequence_no).

        On the path layout the ``bucket`` directory is a join key too, so dynamic
        partition pruning reads only the buckets of the joined books."""
        frags = self.fragment_rows(file_id)
        if "bucket" in frags.columns:
            rows = rows.withColumn("bucket", bucket_of("file_id", self.buckets))
            return rows.join(frags.select("bucket", *KEYS, *cols), ["bucket", *KEYS]).drop("bucket")
        return rows.join(frags.select(*KEYS, *cols), KEYS)

    def universe(self, file_id: int | None = None) -> DataFrame:
        """All fragment keys (needed by negations)."""
        return self.fragment_rows(file_id).select(*KEYS)

    def file_rows(self, file_id: int | None = None) -> DataFrame:
        f = self.files
        if file_id is not None:
            if "bucket" in f.columns:
                f = f.filter(F.col("bucket") == file_id % self.buckets)
            f = f.filter(F.col("file_id") == file_id)
        return f

    # --- catalog tables bucketed by file_id ---------------------------------
    def write_tables(
        self, name: str, buckets: int = DEFAULT_TABLE_BUCKETS, files_per_bucket: int | None = None, path: str | None = None
    ) -> "TextIndex":
        """Save ``<name>_files``, ``<name>_fragments``, ``<name>_postings`` as
        catalog tables, all ``bucketBy(buckets, file_id)``.

        Books, fragments and postings of one ``file_id`` share a bucket, so a
        search reads the postings of its lexemes already partitioned by book:
        fragment windows, the top covers per book and the join back to the
        token arrays run without an exchange (with
        ``spark.sql.requireAllClusterKeysForCoPartition=false``, so the
        ``(file_id, sequence_no)`` joins may use the ``file_id`` buckets).
        Postings are sorted by lexeme inside every bucket file, so Parquet
        statistics skip row groups of other lexemes. ``files_per_bucket`` tasks
        write each bucket (as many as its texts need, if not given), keeping write tasks
        small at any scale; fragments and lists are made by the task that writes them,
        from its books. ``path`` puts
        the (then external) tables under that folder instead of the warehouse.
        """
        if files_per_bucket is None:
            files_per_bucket = -(-text_bytes(self.files) // (buckets * TABLE_TASK_TEXT))
        n = buckets * max(1, int(files_per_bucket))

        def save(df: DataFrame, table: str, sort_cols: list[str], options: dict | None = None) -> None:
            w = (
                df.write.mode("overwrite")
                .format("parquet")
                .options(**(options or {}))
                .bucketBy(buckets, "file_id")
                .sortBy(*sort_cols)
            )
            if path is not None:
                w = w.option("path", os.path.join(path, table))
            w.saveAsTable(table)

        from quire.sources.books import not_null_checked

        books = not_null_checked(self.files.select(*FILES_COLUMNS)).repartition(n, "file_id")
        frags = fragments(books, self.max_tokens, self.config, keep=BOOK_FIELDS)
        save(books, f"{name}_files", ["file_id"])
        save(frags.select(*FRAGMENT_COLUMNS), f"{name}_fragments", ["file_id", "sequence_no"])
        save(position_lists(frags, config=self.config), f"{name}_postings", ["lexeme", "file_id", "sequence_no"], POSTINGS_OPTIONS)
        words = lexicon(self.spark.table(f"{name}_postings")).repartitionByRange("lexeme").sortWithinPartitions("lexeme")
        w = words.write.mode("overwrite").format("parquet")
        (w if path is None else w.option("path", os.path.join(path, f"{name}_lexicon"))).saveAsTable(f"{name}_lexicon")
        if path is not None:
            meta = [(buckets, self.config, self.max_tokens)]
            self.spark.createDataFrame(meta, META_SCHEMA).coalesce(1).write.mode("overwrite").json(
                os.path.join(path, "_meta")
            )
        return TextIndex.load_tables(self.spark, name, self.config, self.max_tokens)

    @classmethod
    def attach_tables(cls, spark: SparkSession, name: str, path: str) -> "TextIndex":
        """Register tables written by ``write_tables(name, path=path)`` in this
        session's catalog (bucketing declared again) and load them; for
        sessions without a shared metastore."""
        meta = spark.read.schema(META_SCHEMA).json(os.path.join(path, "_meta")).first()
        sorts = {
            "files": "file_id",
            "fragments": "file_id, sequence_no",
            "postings": "lexeme, file_id, sequence_no",
        }
        for table, sort in sorts.items():
            cols = TABLE_SCHEMAS[table].replace(OWN + ", bucket int", "")
            location = os.path.join(path, f"{name}_{table}").replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name}_{table} ({cols}) USING parquet "
                f"CLUSTERED BY (file_id) SORTED BY ({sort}) INTO {int(meta['buckets'])} BUCKETS "
                f"LOCATION '{location}'"
            )
        location = os.path.join(path, f"{name}_lexicon").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_lexicon (lexeme string, n_fragments long) USING parquet LOCATION '{location}'")
        return cls.load_tables(spark, name, meta["config"], meta["max_tokens"])

    @classmethod
    def load_tables(
        cls, spark: SparkSession, name: str, config: str = "simple", max_tokens: int | None = DEFAULT_MAX_TOKENS
    ) -> "TextIndex":
        return cls(
            spark.table(f"{name}_files"),
            spark.table(f"{name}_fragments"),
            spark.table(f"{name}_postings"),
            config,
            max_tokens,
            co_partitioned=True,
            words=spark.table(f"{name}_lexicon"),
        )

    # --- persistence -----------------------------------------------------
    def write(self, path: str, mode: str = "overwrite", buckets: int | None = None) -> "TextIndex":
        """Write files, fragments and postings under ``path``; return the loaded index.

        ``buckets`` (default: this index's) sets the number of ``bucket=`` directories
        of each version."""
        n = int(buckets or self.buckets)
        if mode != "overwrite":
            raise ValueError("a written index is replaced as a whole; change it with apply_changes")
        for name in (*TABLE_SCHEMAS, "lexicon", "changed", "_commits"):  # nothing of an index that stood here before stays
            remove(self.spark, os.path.join(path, name))
        meta = [(n, self.config, self.max_tokens)]
        self.spark.createDataFrame(meta, META_SCHEMA).coalesce(1).write.mode("overwrite").json(os.path.join(path, "_meta"))
        writer = uuid.uuid4().hex
        write_version(self.spark, path, 0, writer, self.files, self.config, self.max_tokens, n)
        if not commit(self.spark, path, 0, 0, writer):
            raise RuntimeError(f"another writer began an index at {path}")
        return TextIndex.load(self.spark, path)

    @classmethod
    def ingest(
        cls, raw: DataFrame, path: str, config: str = "simple", max_tokens: int | None = DEFAULT_MAX_TOKENS,
        buckets: int = DEFAULT_BUCKETS, strict: bool = False,
    ) -> tuple["TextIndex", DataFrame]:
        """Raw book files ``(path, value)`` -> the written ``files``, ``fragments``
        and ``postings`` under ``path``, plus the rejects."""
        from quire.sources.books import ingest

        files, rejects = ingest(raw, strict=strict)
        return cls.build(files, max_tokens, config).write(path, buckets=buckets), rejects

    @classmethod
    def create_empty(
        cls,
        spark: SparkSession,
        path: str,
        config: str = "simple",
        max_tokens: int | None = DEFAULT_MAX_TOKENS,
        buckets: int = DEFAULT_BUCKETS,
    ) -> "TextIndex":
        """Write an empty index (schemas only) at ``path``."""
        files = spark.createDataFrame([], FILES_SCHEMA)
        return cls.build(files, max_tokens, config).write(path, buckets=buckets)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        try:
            return bool(spark.read.schema(META_SCHEMA).json(os.path.join(path, "_meta")).take(1))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, config: str | None = None, max_tokens: int | None = None
    ) -> "TextIndex":
        """Open the newest committed version of a written index; settings not given come
        from its ``_meta``."""
        meta = spark.read.schema(META_SCHEMA).json(os.path.join(path, "_meta")).first()
        versions = committed(spark, path)
        shown = {name: live_rows(spark, path, name, versions) for name in TABLE_SCHEMAS}
        return cls(
            shown["files"],
            shown["fragments"],
            shown["postings"],
            config or meta["config"],
            max_tokens if max_tokens is not None else meta["max_tokens"],
            buckets=meta["buckets"],
            version=versions[-1][0],
            words=read_versions(spark, path, "lexicon", LEXICON_SCHEMA, versions),
        )


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def committed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, writer) of the newest base (compaction) and all versions after it."""
    rows = spark.read.schema(COMMIT_SCHEMA).json(os.path.join(path, "_commits")).collect()  # a row per version
    newest = max(rows, key=lambda r: r["version"])
    return sorted((r["version"], r["writer"]) for r in rows if r["version"] >= newest["base"])


def live_rows(spark: SparkSession, path: str, name: str, versions: list[tuple[int, str]]) -> DataFrame:
    """The rows of a table that count: of each book those of the newest version that
    names it (for postings: that changed its text). Only books changed since the last
    compaction are joined; an index without changes is read as it is."""
    schema = TABLE_SCHEMAS[name]
    if len(versions) == 1:
        return read_versions(spark, path, name, schema, versions)
    changed = read_versions(spark, path, "changed", CHANGED_SCHEMA, versions[1:])
    if name == "postings":
        changed = changed.filter("text")
    newest = changed.groupBy("file_id").agg(F.max("version").alias("_newest"))
    # what the newest version wrote counts as it is: no other names its books later
    older = read_versions(spark, path, name, schema, versions[:-1]).join(newest, "file_id", "left")
    older = older.filter(F.col("_newest").isNull() | (F.col("version") == F.col("_newest"))).drop("_newest")
    return older.unionByName(read_versions(spark, path, name, schema, versions[-1:]))


def text_bytes(files: DataFrame) -> int:
    return files.agg(F.sum(F.octet_length("content"))).first()[0] or 0


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Reads take at most ``TASK_FRAGMENTS`` bytes a task: a task's postings are several
    times as large as the fragments, and are sorted in memory."""
    before = spark.conf.get(SPLIT_BYTES)
    sizes = spark._jvm.org.apache.spark.network.util.JavaUtils
    if sizes.byteStringAsBytes(before) > TASK_FRAGMENTS:
        spark.conf.set(SPLIT_BYTES, str(TASK_FRAGMENTS))
    try:
        yield
    finally:
        spark.conf.set(SPLIT_BYTES, before)


def write_version(
    spark: SparkSession, path: str, version: int, writer: str, files: DataFrame, config: str, max_tokens: int | None, buckets: int, kept: DataFrame | None = None
) -> None:
    """Write one version's rows of all tables (invisible until its commit). Books of
    ``kept`` (file_id) keep the postings that they have.

    Books are dealt out by ranges of (bucket, file_id): many tasks share a big bucket. Texts
    are dealt before they are analysed: fragments, several times as large, are made where
    they are written. Postings are made by the tasks that read the fragments, without a
    shuffle: each of their files holds the words of some books of one bucket in order."""
    from quire.sources.books import not_null_checked

    at = lambda name: os.path.join(path, name, f"version={version}", f"writer={writer}")

    def save(df: DataFrame, name: str, order: list[str], options: dict | None = None) -> None:
        df.sortWithinPartitions("bucket", *order).write.mode("overwrite").options(compression="zstd", **(options or {})).partitionBy("bucket").parquet(at(name))

    mine = [(version, writer)]
    own = lambda name, cols: read_versions(spark, path, name, TABLE_SCHEMAS[name], mine).select(*cols)
    bucket = bucket_of("file_id", buckets)
    books = not_null_checked(files.select(*FILES_COLUMNS)).withColumn("bucket", bucket)
    save(books.repartitionByRange("bucket", "file_id"), "files", ["file_id"])
    books = own("files", [*FILES_COLUMNS, "bucket"])
    dealt = books.repartitionByRange(1 + text_bytes(books) // TASK_TEXT, "bucket", "file_id")
    save(fragments(dealt, max_tokens, config, keep=(*BOOK_FIELDS, "bucket")), "fragments", ["file_id", "sequence_no"])
    frags = own("fragments", FRAGMENT_COLUMNS)
    if kept is not None:
        frags = frags.join(kept, "file_id", "left_anti")
    lists = position_lists(frags, config=config).withColumn("bucket", bucket)
    with small_splits(spark):
        save(lists, "postings", ["lexeme", "file_id", "sequence_no"], POSTINGS_OPTIONS)
    words = lexicon(own("postings", ["lexeme"]))
    words.repartitionByRange("lexeme").sortWithinPartitions("lexeme").write.mode("overwrite").option("compression", "zstd").parquet(at("lexicon"))


def commit(spark: SparkSession, path: str, version: int, base: int, writer: str) -> bool:
    """Make a writer's version visible: one small file, which must not be there yet.
    False if another writer made this version."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_commits", f"version={version}", "marker.json"))
    try:
        out = marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(json.dumps({"base": base, "writer": writer}).encode())
    out.close()
    return True
