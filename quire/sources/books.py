"""Book files: list, read whole, parse title / author / body, chunk by words,
assign file ids.

Folders are listed, and their files read, by the tasks (one row per file), so that
no list of files is held by the driver; ``spark.read`` does it for a single folder and
for stores that only Spark can open. Parsing is ``regexp_extract`` with a per-row pattern
built from the parsed title. Nothing is collected: the rejects of a strict load are a
table in the shared folder, of which the driver sees the count and the first name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- Fixed values: book file layout (header lines and body markers) ---
TITLE_LINE = r"Title: (.+)\R"
AUTHOR_LINE = r"Author: (.+)\R"
START_MARK = "*** START OF THE PROJECT GUTENBERG EBOOK "
END_MARK = "*** END OF THE PROJECT GUTENBERG EBOOK "
MARK_TAIL = " ***"
# Set-based parser patterns (every match counts).
TITLE_ALL = r"Title: ([^\r]+)"
AUTHOR_ALL = r"Author: ([^\r]+)"
BODY_ALL = (
    r"\*\*\* START OF THE PROJECT GUTENBERG EBOOK [^\r]+\r([\w|\W]+)"
    r"\*\*\* END OF THE PROJECT GUTENBERG EBOOK"
)
TXT_NAME = ".txt"  # matched as a regex: '.' is any character
WORD_SPLIT = r"\s"
DEFAULT_CHUNK_WORDS = 8000
# Written texts: the most folders that books are dealt over, and how Spark names a partition's folder.
RACKS = 512
UNSAFE = r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Listing: levels of folders that are dealt out before a task walks what is below, what a batch holds,
# and the letters that make Spark's readers take a path as a pattern.
DEALT_LEVELS = 2
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
PATTERN_LETTERS = set("{}[]*?\\")

BOOK_SCHEMA = "filename string, title string, author string, content string"


def is_hidden(name: str) -> bool:
    """Names of folders and files that Spark's readers pass over."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or is_aside(name)


def is_aside(name: str) -> bool:
    """Names of files that Spark's readers find but do not read."""
    return name.startswith("_") and "=" not in name


def entries(system: fs.FileSystem, folder: str, fits: re.Pattern) -> Iterator[tuple[str, bool]]:
    """What Spark's readers see in a folder, as ``(path, is a folder)``: of the files those
    that are not empty and whose names fit."""
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        name = info.base_name
        if is_hidden(name):
            continue
        if info.type == fs.FileType.Directory:
            yield info.path, True
        elif info.type == fs.FileType.File and info.size and not is_aside(name) and fits.fullmatch(name):
            yield info.path, False


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; bytes, if any, are a row's last value."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*held), schema.types)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def files_under(spark: SparkSession, directory: str, glob: str | None = None, whole: bool = False) -> DataFrame | None:
    """``(path)`` of all files under a folder whose names match ``glob``, with ``whole``
    also their bytes as ``value``: the same files as Spark's recursive lookup gives.

    Spark's readers hold every file in the driver and open few of them in a task. Here
    tasks list the folders, whenever the rows are asked for: two levels of them are dealt
    out, a task walks what is below and holds the names of one folder at a time. None where
    only Spark's readers serve: stores that tasks cannot open, patterns, single files."""
    from quire.llm.files import locate

    top = spark._jvm.org.apache.hadoop.fs.Path(directory)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if PATTERN_LETTERS & set(directory) or not store.exists(top) or not store.getFileStatus(top).isDirectory():
        return None
    base = store.makeQualified(top).toString().rstrip("/")
    try:
        root = locate(base)[1].rstrip("/")
    except (pa.ArrowException, OSError):
        return None
    fits = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(glob or "*").compiled().pattern(), re.DOTALL)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool]]:
        for batch in batches:
            yield from zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist())

    def one_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = locate(base)[0]
        rows = (e for path, folder in given(batches) for e in (entries(system, path, fits) if folder else [(path, False)]))
        yield from in_batches(rows, pa.schema([("path", pa.string()), ("folder", pa.bool_())]))

    def below(system: fs.FileSystem, path: str, folder: bool) -> Iterator[str]:
        if not folder:
            yield path
            return
        ahead = [path]
        while ahead:
            for at, deeper in entries(system, ahead.pop(), fits):
                if deeper:
                    ahead.append(at)
                else:
                    yield at

    def content(system: fs.FileSystem, path: str) -> bytes:
        with system.open_input_file(path) as f:
            return f.read()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = locate(base)[0]
        paths = (path for start in given(batches) for path in below(system, *start))
        if whole:
            rows = ((base + path[len(root) :], content(system, path)) for path in paths)
            yield from in_batches(rows, pa.schema([("path", pa.string()), ("value", pa.binary())]))
        else:
            yield from in_batches(((base + path[len(root) :],) for path in paths), pa.schema([("path", pa.string())]))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(0, 1, 1, 1).select(F.lit(root or "/").alias("path"), F.lit(True).alias("folder"))
    for _ in range(DEALT_LEVELS):
        found = found.mapInArrow(one_level, "path string, folder boolean").repartition(tasks)
    return found.mapInArrow(walk, "path string, value binary" if whole else "path string")


def list_text_files(spark: SparkSession, directory: str, glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """``(path)`` of the files in ``directory`` whose names match ``glob``."""
    found = files_under(spark, directory, glob) if recursive else None
    if found is not None:
        return found
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(directory).select("path")


def ls_files(
    spark: SparkSession, path: str, predicate: Column | str | None = None, sort: str | Column = "filename"
) -> DataFrame:
    """Every file under ``path`` as ``(filename)``, filtered by a predicate
    (a Column, or a SQL expression over ``filename`` parsed by Spark as one
    expression — never spliced into a command) and ordered by ``sort``."""
    if isinstance(predicate, str):
        predicate = F.expr(predicate)
    found = files_under(spark, path)
    if found is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = found.select(F.col("path").alias("filename"))
    if predicate is not None:
        df = df.filter(predicate)
    return df.orderBy(sort)


def txt_like(name: Column) -> Column:
    """S3: ``substring(name, '.txt') <> ''`` (a regex search)."""
    return F.regexp_extract(name, TXT_NAME, 0) != ""


def file_path() -> Column:
    """The source file of a row as a plain path (``_metadata.file_path`` is URL
    encoded; a literal '+' is protected from the decoding)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def is_plain(spark: SparkSession, glob: str) -> bool:
    """No name that matches ``glob`` ends as those of compressed files do, which Spark's
    reader unpacks."""
    ending = re.split(r"[{}\[\]*?\\]", glob)[-1]
    hadoop = spark._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    return "." in ending and codecs.getCodec(hadoop.fs.Path("a" + ending)) is None


def read_texts(spark: SparkSession, directory: str, glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """``(path, value)`` with each whole file as one UTF-8 string."""
    found = files_under(spark, directory, glob, whole=True) if recursive and is_plain(spark, glob) else None
    if found is not None:
        return found.select("path", F.col("value").cast("string").alias("value"))
    r = spark.read.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.text(directory, wholetext=True).select(file_path().alias("path"), "value")


def base_name(path: Column) -> Column:
    """Last path segment."""
    return F.element_at(F.split(path, "/"), -1)


def _quoted(text: Column) -> Column:
    """Literal regex text (``\\Q...\\E``, with ``\\E`` inside escaped)."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _regex_lit(text: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in text)


def parse_strict_columns(value: Column) -> tuple[Column, Column, Column]:
    """S5 columns (title, author, body), each null when missing."""
    title = F.nullif(F.regexp_extract(value, TITLE_LINE, 1), F.lit(""))
    author = F.nullif(F.regexp_extract(value, AUTHOR_LINE, 1), F.lit(""))
    upper = _quoted(F.upper(title))
    pattern = F.concat(
        F.lit("(?s)" + _regex_lit(START_MARK)),
        upper,
        F.lit(_regex_lit(MARK_TAIL) + "(.+)" + _regex_lit(END_MARK)),
        upper,
        F.lit(_regex_lit(MARK_TAIL)),
    )
    body = F.nullif(F.call_function("regexp_extract", value, pattern, F.lit(1)), F.lit(""))
    return title, author, body


def parsed_books(raw: DataFrame) -> DataFrame:
    """S5 over ``raw(path, value)``: path, base file name, title, author, content and
    ``reason`` (null for a book; else what is missing)."""
    title, author, body = parse_strict_columns(F.col("value"))
    parsed = raw.select(
        "path", base_name(F.col("path")).alias("filename"), title.alias("title"), author.alias("author"),
        body.alias("content"),
    )
    reason = (
        F.when(F.col("title").isNull(), F.lit("no title"))
        .when(F.col("author").isNull(), F.lit("no author"))
        .when(F.col("content").isNull(), F.lit("no body"))
    )
    return parsed.withColumn("reason", reason)


def split_parsed(parsed: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(books, rejects)`` of ``parsed_books`` rows. ``strict=True`` raises ValueError
    if there are rejects; the error names the table (in the shared folder) that lists
    every rejected file."""
    books = parsed.filter("reason is null").select("filename", "title", "author", "content")
    rejects = parsed.filter("reason is not null").select("path", "reason")
    if strict:
        listed = shared_path(parsed.sparkSession, "quire-rejects")
        rejects.write.parquet(listed)
        told = parsed.sparkSession.read.schema(rejects.schema).parquet(listed)
        n, first = told.agg(F.count("*"), F.min("path")).first()
        if n:
            raise ValueError(f"cannot parse {n} book file(s), the first is {first}; all are listed in {listed}")
    return books, rejects


def parse_books(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """S5 strict parser over ``raw(path, value)`` (lazy).

    Returns ``(books, rejects)``: books ``(filename, title, author, content)`` with
    the base file name; rejects ``(path, reason)`` lack a title, an author or a body.
    """
    return split_parsed(parsed_books(raw), strict)


def shared_path(spark: SparkSession, prefix: str) -> str:
    from quire.session import require_checkpoint_dir

    return f"{require_checkpoint_dir(spark)}/{prefix}-{uuid.uuid4().hex}"


def parse_books_all(raw: DataFrame) -> DataFrame:
    """S6 set-based parser: every title x every author x every body of a file
    (full path as ``filename``); a file missing any part gives no row."""
    # outer generators + a null filter after them: an inner explode would get an
    # inferred size filter that evaluates each regex over the whole book twice
    def each(df, cols, pattern, name):
        x = df.select(*cols, F.explode_outer(F.regexp_extract_all("value", F.lit(pattern), 1)).alias(name))
        return x.filter(F.col(name).isNotNull())

    t = each(raw.select(F.col("path").alias("filename"), "value"), ["filename", "value"], TITLE_ALL, "title")
    a = each(t, ["filename", "value", "title"], AUTHOR_ALL, "author")
    return each(a, ["filename", "title", "author", "value"], BODY_ALL, "content").select(
        "filename", "title", "author", "content"
    )


def totals_before(rows: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """``(key, name)``: the sum of ``amount`` over all smaller keys, for distinct keys.

    A prefix sum in two levels: keys are range-partitioned and pinned by a reliable
    checkpoint, summed inside each partition, and shifted by the totals of the earlier
    partitions (a table with one row per partition)."""
    from quire.session import require_checkpoint_dir

    require_checkpoint_dir(rows.sparkSession)
    ranked = rows.select(key, amount).repartitionByRange(key)
    ranked = ranked.withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy("_part").agg(F.sum(amount).alias("_n"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier(Window.orderBy("_part"))), F.lit(0)).alias("_shift"))
    inside = F.sum(amount).over(earlier(Window.partitionBy("_part").orderBy(key)))
    local = ranked.select(key, "_part", F.coalesce(inside, F.lit(0)).alias("_local"))
    # one row per partition: a proven bound for the broadcast
    return local.join(F.broadcast(shifts), "_part").select(key, (F.col("_shift") + F.col("_local")).alias(name))


def word_chunks(books: DataFrame, size: int = DEFAULT_CHUNK_WORDS, over_all: bool = False) -> DataFrame:
    """Split each body on every single blank (empty words kept), number
    the words of a file from 1 (its rows in order of title, author and content), group
    by title and ``wordno / size`` (so the first chunk holds ``size - 1`` words), join
    by one blank, take the largest author and number the chunks per file. With
    ``over_all`` the words of all files are numbered in one run, files in order of their
    names, so that a file's first chunk ends where the run's chunk does; chunks still hold
    words of one file. The run is a prefix sum over the files' word counts.

    ``(seq_no, filename, title, author, content)``; one shuffle, by file name: no group
    is larger than a chunk, and only a file's own rows meet.
    """
    n = int(size)
    if n < 1:
        raise ValueError("size must be positive")
    # texts travel as they are, their words (several times as large) are split in the task
    # that cuts them; that split is a column of its own: used inside the per-chunk lambda
    # as an expression it would be recomputed for every chunk
    words_of = F.split(F.col("content"), WORD_SPLIT, -1)
    rows = books.select("filename", "title", "author", "content", F.size(words_of).alias("_n"))
    in_order = Window.partitionBy("filename").orderBy("title", "author", "content")
    before = F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_o", before)
    if over_all:
        counted = books.groupBy(F.coalesce("filename", F.lit("")).alias("_file")).agg(F.sum(F.size(words_of)).alias("_n"))
        start = totals_before(counted, "_file", "_n", "_start")
        rows = rows.join(start, F.coalesce("filename", F.lit("")) == start["_file"]).withColumn("_o", F.col("_o") + F.col("_start"))
    rows = rows.select("filename", "title", "author", "_o", words_of.alias("_w"))
    words, offset = F.col("_w"), F.col("_o")
    first, last = F.floor((offset + 1) / n), F.floor((offset + F.size(words)) / n)

    def cut(k: Column) -> Column:
        """Words ``max(k n, offset + 1) .. min(k n + n - 1, offset + size)`` of the file."""
        start = F.greatest(k * n - offset, F.lit(1))
        end = F.least(k * n + n - 1 - offset, F.size(words))
        cut_words = F.slice(words, start.cast("int"), (end - start + 1).cast("int"))
        return F.struct(k.alias("k"), (offset + start).alias("at"), F.size(cut_words).alias("n"), F.array_join(cut_words, " ").alias("w"))

    # (outer: no inferred filter re-splitting the book)
    cuts = rows.select("filename", "title", "author", F.explode_outer(F.transform(F.sequence(first, last), cut)).alias("c"))
    cuts = cuts.filter(F.col("c").isNotNull() & (F.col("c.n") > 0)).select("filename", "title", "author", "c.k", "c.at", "c.w")
    parts = F.array_sort(F.collect_list(F.struct("at", "w")))
    chunks = cuts.groupBy("filename", "title", "k").agg(F.max("author").alias("author"), parts.alias("_p"))
    numbered = Window.partitionBy("filename").orderBy("title", "k")
    return chunks.select(
        F.row_number().over(numbered).cast("long").alias("seq_no"),
        "filename",
        "title",
        "author",
        F.array_join(F.transform("_p", lambda p: p["w"]), " ").alias("content"),
    )


def consecutive_ids(keys: DataFrame, key: str, start: Column | int = 0, name: str = "id") -> DataFrame:
    """Distributed ``row_number() OVER (ORDER BY key) + start`` for distinct keys.

    Keys are range-partitioned and sorted (many tasks), pinned by a reliable
    checkpoint, numbered inside each partition, and shifted by the sizes of the
    earlier partitions (a table with one row per partition).
    """
    spark = keys.sparkSession
    ranked = keys.select(key).repartitionByRange(key).sortWithinPartitions(key)
    mid = F.monotonically_increasing_id()
    ranked = ranked.select(key, (mid.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_local"), F.shiftright(mid, 33).alias("_part"))
    from quire.session import require_checkpoint_dir

    require_checkpoint_dir(spark)
    ranked = ranked.checkpoint(eager=True)
    sizes = ranked.groupBy("_part").agg(F.max("_local").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    # one row per partition: a proven bound for the broadcast
    return ranked.join(F.broadcast(offsets), "_part").select(
        key, (start_col + F.col("_off") + F.col("_local")).cast("long").alias(name)
    )


def assign_file_ids(books: DataFrame, existing: DataFrame | None = None, reuse: bool = False) -> DataFrame:
    """Ids continue after ``max(existing.file_id)`` in filename order; ids are
    computed on the filename column alone and joined back.

    ``reuse``: a book whose filename is already in ``existing`` keeps its id (an
    update of its content rather than a new row)."""
    cols = ["file_id", "filename", "title", "author", "content"]
    start = 0
    old = None
    if existing is not None:
        start = existing.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
        if reuse:
            # only the batch's own names are looked up in the (large) files table
            known = existing.select("filename", "file_id").join(books.select("filename"), "filename", "left_semi")
            tagged = books.join(known.dropDuplicates(["filename"]), "filename", "left")
            old = tagged.filter(F.col("file_id").isNotNull()).select(*cols)
            books = tagged.filter(F.col("file_id").isNull()).drop("file_id")
    ids = consecutive_ids(books.select("filename").distinct(), "filename", int(start), "file_id")
    new = books.join(ids, "filename").select(*cols)
    return new if old is None else old.unionByName(new)


def not_null_checked(df: DataFrame, cols=("file_id", "filename", "title", "author", "content")) -> DataFrame:
    """NOT NULL check of the ``files`` sink, evaluated by the write itself: a
    row with a null in ``cols`` fails the job (no separate counting pass)."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    msg = F.concat(F.lit("null in a NOT NULL column of files: "), F.coalesce(F.col("filename"), F.lit("?")))
    return df.withColumn("file_id", F.when(bad, F.raise_error(msg).cast("long")).otherwise(F.col("file_id")))


def ingest(raw: DataFrame, existing: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw files -> ``files`` rows with new ids, plus the rejects. Each book is
    read and parsed once: the parsed rows are a table in the shared folder, from which
    ids (file names alone), books and rejects are read."""
    spark, parsed = raw.sparkSession, parsed_books(raw)
    path = shared_path(spark, "quire-parsed")
    parsed.write.parquet(path)
    books, rejects = split_parsed(spark.read.schema(parsed.schema).parquet(path), strict)
    return assign_file_ids(books, existing), rejects


def append_books(raw: DataFrame, existing: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """S9/S10 that may be repeated: of the raw files only books that ``existing`` does not
    hold - by file name and digest of the content - get ids, after its largest, in order
    of file name and digest. Loading a folder again adds what is new in it, and nothing
    else. Each book is read and parsed once, into a table in the shared folder. Returns the
    new rows of ``files`` and the rejects."""
    spark, digest = raw.sparkSession, F.sha2(F.col("content").cast("binary"), 256).alias("_digest")
    parsed = parsed_books(raw).select("*", digest, F.monotonically_increasing_id().alias("_row"))
    path = shared_path(spark, "quire-parsed")
    parsed.write.parquet(path)
    parsed = spark.read.schema(parsed.schema).parquet(path)
    _, rejects = split_parsed(parsed, strict)
    books = parsed.filter("reason is null")
    # names, digests and row numbers decide; the texts are read once more for the new rows
    known = existing.select("filename", digest)
    fresh = books.join(known, ["filename", "_digest"], "left_anti").groupBy("filename", "_digest")
    fresh = fresh.agg(F.min_by("_row", F.struct("title", "author", "_row")).alias("_row"))
    fresh = fresh.select("_row", F.concat("filename", F.lit("\u0000"), "_digest").alias("_key")).checkpoint(eager=True)
    start = existing.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    ids = consecutive_ids(fresh.select("_key"), "_key", int(start), "file_id")
    numbered = fresh.join(ids, "_key").select("_row", "file_id")
    return books.join(numbered, "_row").select("file_id", "filename", "title", "author", "content"), rejects


def folder_name(value: Column) -> Column:
    """A value as Spark names the folder of a partition by it."""
    letter = lambda c: F.when(c.rlike(UNSAFE), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)
    safe = F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)(.)"), F.lit(1)), letter), "")
    return F.coalesce(F.nullif(F.when(value.rlike(UNSAFE), safe).otherwise(value), F.lit("")), F.lit(NO_VALUE))


def write_texts(raw: DataFrame, directory: str) -> None:
    """Each path of ``raw(path, value)`` as a text file of its own, a line per row, in
    nested folders: ``rack=<number>/shelf=<folder of path>/book=<name>/``.

    Spark's own writer takes a partition's folder, a checksum file and two commits for
    every book; here the tasks write the files (a draft that is moved into place, one book
    open at a time). Every task fills a rack, and racks are numbered in order of the folders
    in them, so that the files' paths are in the same order as without racks; a listing
    deals the racks out to tasks, whatever the number of shelves and books."""
    from quire.llm.files import locate, write_whole

    spark = raw.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(directory)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        raise ValueError(f"{directory} is there already")
    system, root = locate(directory)
    system.create_dir(root, recursive=True)
    shelf = folder_name(F.regexp_replace("path", "/[^/]*$", ""))
    # (with its closing slash: in order of the files' paths)
    place = F.concat(F.lit("shelf="), shelf, F.lit("/book="), folder_name(base_name(F.col("path"))), F.lit("/"))
    x = raw.select(place.alias("place"), "value")
    many = int(spark.conf.get("spark.sql.shuffle.partitions")) > RACKS
    x = (x.repartitionByRange(RACKS, "place") if many else x.repartitionByRange("place")).sortWithinPartitions("place")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(name) for name in ("place", "value")]
            for k in range(batch.num_rows):  # a text at a time
                yield tuple(c[k].as_py() for c in columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rack = 0, f"{TaskContext.get().partitionId():05d}"
        for place, book_rows in groupby(rows(batches), key=lambda r: r[0]):

            def fill(out):
                for _, value in book_rows:
                    out.write((value or "").encode() + b"\n")

            write_whole(f"{directory}/rack={rack}/{place[:-1]}", "book.txt", fill)
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    x.mapInArrow(write, "n long").agg(F.sum("n")).first()


def shelf_name(path: Column) -> Column:
    """The ``path`` that a file of ``write_texts`` was written for."""
    return F.concat_ws("/", F.regexp_extract(path, "/shelf=([^/]*)/", 1), F.regexp_extract(path, "/book=([^/]*)/", 1))


# --- raw books made from the driver's documents (both engines build them alike) ---
#: Of every ``VARIED`` books by id: 3 has a second author, 5 a second title, 7 no author,
#: 9 its END line twice (inside the body, then at its end).
VARIED = 11


def raw_books_from_files(files: DataFrame) -> DataFrame:
    """``(path, value)``: title, author and START/END marker lines around the
    text, lines ended by CRLF, as a book file looks."""
    up = F.upper(F.col("title"))
    kind = F.pmod(F.col("file_id"), F.lit(VARIED))
    line = lambda when, *parts: F.when(when, F.concat(*parts)).otherwise(F.lit(""))
    end = F.concat(F.lit("\r\n"), F.lit(END_MARK), up, F.lit(MARK_TAIL + "\r\n"))
    value = F.concat(
        F.lit("Title: "), F.col("title"), F.lit("\r\n"),
        line(kind == 5, F.lit("Title: Another "), F.col("title"), F.lit("\r\n")),
        line(kind != 7, F.lit("Author: "), F.col("author"), F.lit("\r\n")),
        line(kind == 3, F.lit("Author: Also "), F.col("author"), F.lit("\r\n")),
        F.lit("\r\n"),
        F.lit(START_MARK), up, F.lit(MARK_TAIL + "\r\n"),
        F.replace(F.col("content"), F.lit("\n"), F.lit("\r\n")),
        end,
        line((kind == 9) & ~F.contains("title", F.lit("ß")), end),  # engines differ on its capital
    )
    return files.select(F.col("filename").alias("path"), value.alias("value"))
