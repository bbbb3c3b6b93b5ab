"""Book files: listing, whole-text reading, strict / set-based parsing, chunks, ids."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from quire.sources.books import (
    file_path,
    ingest,
    list_text_files,
    ls_files,
    parse_books,
    parse_books_all,
    read_texts,
    shelf_name,
    txt_like,
    word_chunks,
)

BOOK = (
    "Title: {t}\r\nAuthor: {a}\r\n\r\n*** START OF THE PROJECT GUTENBERG EBOOK {T} ***\r\n"
    "{body}\r\n*** END OF THE PROJECT GUTENBERG EBOOK {T} ***\r\n"
)


def write(d, name, text):
    with open(os.path.join(d, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.fixture()
def book_dir(tmpdir_path):
    d = tmpdir_path
    write(d, "a.txt", BOOK.format(t="A (B)?", a="Ann", T="A (B)?", body="one two\r\nthree"))
    write(d, "b.txt", BOOK.format(t="Sea", a="Bo", T="SEA", body="x") + "more\r\n*** END OF THE PROJECT GUTENBERG EBOOK SEA ***\r\n")
    write(d, "c.txt", "Author: Nobody\r\nno title here\r\n")
    write(d, "notes.md", "Title: skip\r\n")
    os.makedirs(os.path.join(d, "sub"))
    write(os.path.join(d, "sub"), "d.txt", BOOK.format(t="Deep", a="Di", T="DEEP", body="deep"))
    return d


def test_list_and_read(spark, book_dir):
    names = {os.path.basename(r.path) for r in list_text_files(spark, book_dir).collect()}
    assert names == {"a.txt", "b.txt", "c.txt"}
    rec = {os.path.basename(r.path) for r in list_text_files(spark, book_dir, recursive=True).collect()}
    assert "d.txt" in rec
    ls = [os.path.basename(r.filename) for r in ls_files(spark, book_dir, txt_like(F.col("filename"))).collect()]
    assert ls == sorted(ls) and "notes.md" not in ls and "d.txt" in ls
    raw = read_texts(spark, book_dir)
    texts = {os.path.basename(r.path): r.value for r in raw.collect()}
    assert texts["a.txt"].startswith("Title: A (B)?\r\n")


def test_strict_parser(spark, book_dir):
    books, rejects = parse_books(read_texts(spark, book_dir))
    got = {r.filename: r for r in books.collect()}
    assert got["a.txt"].title == "A (B)?"  # regex metacharacters are quoted
    assert got["a.txt"].content == "\r\none two\r\nthree\r\n"
    assert got["b.txt"].content.endswith("more\r\n")  # body runs to the last END line
    assert {os.path.basename(r.path) for r in rejects.collect()} == {"c.txt"}
    with pytest.raises(ValueError, match="c.txt"):
        parse_books(read_texts(spark, book_dir), strict=True)


def test_set_parser_two_titles(spark, tmpdir_path):
    write(tmpdir_path, "t.txt", "Title: One\r\nTitle: Two\r\n" + BOOK.format(t="One", a="A", T="ONE", body="b"))
    rows = parse_books_all(read_texts(spark, tmpdir_path)).collect()
    assert sorted(r.title for r in rows) == ["One", "One", "Two"]


def test_word_chunks(spark):
    books = spark.createDataFrame([("f", "t", "a", "a b  c d")], "filename string, title string, author string, content string")
    rows = word_chunks(books, 3).orderBy("seq_no").collect()
    assert [r.content for r in rows] == ["a b", " c d"]
    assert [r.seq_no for r in rows] == [1, 2]


def test_ingest_ids_continue(spark, book_dir):
    existing = spark.createDataFrame([(41, "z", "t", "a", "c")], "file_id long, filename string, title string, author string, content string")
    files, _ = ingest(read_texts(spark, book_dir), existing)
    ids = sorted((r.filename, r.file_id) for r in files.collect())
    assert ids == [("a.txt", 42), ("b.txt", 43)]


def test_files_sink_rejects_nulls(spark, tmpdir_path):
    from quire.plans.index import TextIndex

    files = spark.createDataFrame(
        [(1, "a.txt", "A", None, "some text")], "file_id long, filename string, title string, author string, content string"
    )
    with pytest.raises(Exception, match="NOT NULL"):
        TextIndex.build(files).write(os.path.join(tmpdir_path, "idx"))


def test_file_names_are_plain(spark, tmpdir_path):
    write(tmpdir_path, "my book+é.txt", BOOK.format(t="T", a="A", T="T", body="x"))
    books, _ = parse_books(read_texts(spark, tmpdir_path))
    assert [r.filename for r in books.collect()] == ["my book+é.txt"]


def test_consecutive_ids_across_partitions(spark):
    from quire.sources.books import consecutive_ids

    names = spark.range(0, 3000, numPartitions=7).selectExpr("concat('b', lpad(cast(id * 7919 % 3000 as string), 5, '0')) AS filename")
    ids = consecutive_ids(names.repartition(5), "filename", 100, "file_id").collect()
    got = sorted((r.filename, r.file_id) for r in ids)
    assert [i for _, i in got] == list(range(101, 3101))  # consecutive, in name order


def test_word_chunks_edges(spark):
    books = spark.createDataFrame(
        [("f", "t", "a", " a b "), ("g", "t", "a", "x")], "filename string, title string, author string, content string"
    )
    rows = {(r.filename, r.seq_no): r.content for r in word_chunks(books, 2).collect()}
    # words: '' a b '' -> wordno 1..4; chunk 0 = word 1, chunk 1 = words 2-3, chunk 2 = word 4
    assert rows == {("f", 1): "", ("f", 2): "a b", ("f", 3): "", ("g", 1): "x"}
    rows = [r.content for r in word_chunks(books.filter("filename = 'g'"), 1).collect()]
    assert rows == ["x"]  # size 1: wordno/1 >= 1, so no empty first chunk


def test_ls_files_sql_predicate(spark, book_dir):
    names = [os.path.basename(r.filename) for r in ls_files(spark, book_dir, "filename LIKE '%b.txt'").collect()]
    assert names == ["b.txt"]


def test_word_chunks_over_all(spark):
    """Words are numbered through: 'b' begins in the middle of a chunk of the run."""
    rows = [("a", "T", "A", "1 2 3 4"), ("b", "T", "A", "5 6 7"), ("b", "U", "B", "8"), ("c", "T", None, ""), ("d", "T", "A", "10 11 12")]
    books = spark.createDataFrame(rows * 2, "filename string, title string, author string, content string").distinct()
    got = sorted((r.filename, r.seq_no, r.content) for r in word_chunks(books.repartition(4), 3, over_all=True).collect())
    assert got == [("a", 1, "1 2"), ("a", 2, "3 4"), ("b", 1, "5"), ("b", 2, "6 7"), ("b", 3, "8"), ("c", 1, ""), ("d", 1, "10 11"), ("d", 2, "12")]
    assert word_chunks(books.limit(0), 3, over_all=True).count() == 0


def test_written_texts(spark, tmpdir_path):
    """A file for each path, whatever its name, and nothing beside it: no checksum files,
    and racks that bound the folders which a listing deals to tasks."""
    from quire.sources.books import RACKS, shelf_name, write_texts

    rows = [(f"shelf{k % 40}/{k}.txt", f"text {k}\r\nend") for k in range(200)]
    rows += [("a/b/c=d.txt", "x"), ("no folder", "y"), (None, "z"), ("", None), ("twice/t.txt", "1"), ("twice/t.txt", "1")]
    folder = os.path.join(tmpdir_path, "books")
    write_texts(spark.createDataFrame(rows, "path string, value string").repartition(7), folder)
    files = [os.path.join(at, n) for at, _, names in os.walk(folder) for n in names]
    assert len(files) == 204 and {os.path.basename(f) for f in files} == {"book.txt"}
    racks = os.listdir(folder)
    assert all(r.startswith("rack=") for r in racks) and len(racks) <= RACKS
    found = read_texts(spark, folder, recursive=True).select(shelf_name(F.col("path")), "value").collect()
    got = {tuple(r) for r in found}
    assert {(f"shelf{k % 40}/{k}.txt", f"text {k}\r\nend\n") for k in range(200)} <= got
    none = "__HIVE_DEFAULT_PARTITION__"
    assert {v for p, v in got if p == "twice/t.txt"} == {"1\n1\n"} and {("a%2Fb/c%3Dd.txt", "x\n"), ("no folder/no folder", "y\n")} <= got
    assert sorted(v for p, v in got if p == f"{none}/{none}") in (["\nz\n"], ["z\n\n"])
    empty = os.path.join(tmpdir_path, "empty")
    write_texts(spark.createDataFrame([], "path string, value string"), empty)
    assert read_texts(spark, empty, recursive=True).count() == 0


@pytest.fixture()
def many_partitions(spark):
    """Files and shuffles in as many partitions as on a large input."""
    conf = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def shelves(spark, folder, n=200):
    """Book files on ten shelves, as ``write_texts`` leaves them."""
    from quire.sources.books import write_texts

    rows = [(f"s{k % 10}/{k}.txt", BOOK.format(t=f"T{k}", a="A", T=f"T{k}", body=f"text {k}")) for k in range(n)]
    write_texts(spark.createDataFrame(rows, "path string, value string").repartition(7), folder)
    return rows


ODD_NAMES = (
    "a b.txt", "é+%.txt", "sub/_aside.txt", "sub/.dot.txt", "sub/x.txt._COPYING_", "sub/empty.txt", "_h/x.txt", "_h=1/x.txt",
    "_h=1/_a=b.txt", "_metadata/x.txt", "_metadata_f.txt", "_common_metadata.txt", ".d/x.txt", "k=1/x.txt", "sub/1/2/3/z.txt", "sub/1/n.md",
)


def odd_folder(top):
    for name in ODD_NAMES:
        os.makedirs(os.path.dirname(os.path.join(top, name)), exist_ok=True)
        write(top, name, "" if name.endswith("empty.txt") else name)
    with open(os.path.join(top, "bytes.txt"), "wb") as f:
        f.write(b"\xef\xbb\xbfa\xff\xfeb\r\n\n")
    with gzip.open(os.path.join(top, "sub", "packed.txt.gz"), "wb") as f:
        f.write(b"packed")


@pytest.mark.parametrize("glob", ["*.txt", "*", "*.gz", "{a,é}*.t[!a]t"])
def test_read_texts_as_sparks_reader(spark, tmpdir_path, glob):
    """Hidden, empty, oddly named and packed files, bytes that are no text; patterns, single files."""
    odd_folder(tmpdir_path)
    for at in (tmpdir_path, f"file://{tmpdir_path}/", f"{tmpdir_path}/s*", f"{tmpdir_path}/bytes.txt"):
        r = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        whole = r.text(at, wholetext=True).select(file_path().alias("path"), F.hex("value"))
        got = read_texts(spark, at, glob, recursive=True).select("path", F.hex("value"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_texts(spark, f"{tmpdir_path}/nothing", glob, recursive=True)


def test_read_texts_deals_folders_not_files(spark, tmpdir_path, many_partitions):
    """a task reads many books, however many a task of a file scan would open."""
    folder = os.path.join(tmpdir_path, "books")
    rows = shelves(spark, folder)
    raw = read_texts(spark, folder, recursive=True)
    assert raw.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert raw.inputFiles() == []
    assert sorted(r.value for r in raw.collect()) == sorted(v + "\n" for _, v in rows)


@pytest.mark.parametrize("glob", ["*.txt", "*", "{a,é}*.t[!a]t"])
def test_list_as_sparks_reader(spark, tmpdir_path, glob):
    odd_folder(tmpdir_path)
    for at in (tmpdir_path, f"file://{tmpdir_path}/", f"{tmpdir_path}/s*", f"{tmpdir_path}/bytes.txt"):
        r = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        got = sorted(r.path for r in list_text_files(spark, at, glob, recursive=True).collect())
        assert got == sorted(r.path for r in r.load(at).select("path").collect())


def test_list_is_not_held_by_the_driver(spark, tmpdir_path):
    """no file is known before the tasks list the folders."""
    folder = os.path.join(tmpdir_path, "books")
    rows = shelves(spark, folder)
    found = list_text_files(spark, folder, recursive=True)
    assert found.inputFiles() == []
    assert sorted(r.n for r in found.select(shelf_name(F.col("path")).alias("n")).collect()) == sorted(p for p, _ in rows)


def test_ls_files_is_not_held_by_the_driver(spark, tmpdir_path):
    """as F2, with a predicate and in order."""
    odd_folder(tmpdir_path)
    found = ls_files(spark, tmpdir_path, "filename LIKE '%x%'")
    assert found.inputFiles() == []
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tmpdir_path)
    assert [r.filename for r in found.collect()] == sorted(r.path for r in r.filter("path LIKE '%x%'").select("path").collect())


def test_racks_keep_the_order_of_paths(spark, tmpdir_path, many_partitions):
    """ranks by path are those by shelf and book, whatever the rack."""
    from quire.sources.books import consecutive_ids, write_texts

    folder = os.path.join(tmpdir_path, "books")
    names = [f"{s}/{k}.txt" for s in ("a", "a b", "a-b", "a#b", "a=b", "é") for k in range(40)]
    write_texts(spark.createDataFrame([(n, n) for n in names], "path string, value string").repartition(7), folder)
    assert len(os.listdir(folder)) > 1
    ranks = consecutive_ids(ls_files(spark, folder), "filename", name="rank").orderBy("rank").collect()
    below = [r.filename.split("/shelf=")[1] for r in ranks]
    assert len(below) == 240 and below == sorted(below) and below[0].startswith("a b/book=0.txt/")
