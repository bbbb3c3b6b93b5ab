"""Index upkeep on a written index and through the streaming feed (FIXTURES upkeep cases)."""

import os

from pyspark.sql import functions as F

from quire.operators.upkeep import apply_changes, clear, delete, upsert
from quire.plans.index import DEFAULT_BUCKETS, TextIndex
from quire.sources.corpus import files_from_documents
from quire.streaming.feed import start_index_feed

SCHEMA = "file_id long, filename string, title string, author string, content string"
G1 = "the old man and the sea was old"


def frag_set(index):
    return sorted(
        (r.file_id, r.sequence_no, tuple(r.content_array)) for r in index.fragments.select("file_id", "sequence_no", "content_array").collect()
    )


def post_set(index):
    return sorted(tuple(r) for r in index.postings.select("lexeme", "file_id", "sequence_no", "pos").collect())


def test_written_upsert_delete_equals_rebuild(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "idx")
    files = spark.createDataFrame(
        [(1, "g1", "G1", "A", G1), (2, "g2", "G2", "B", "whale one two"), (2 + DEFAULT_BUCKETS, "g3", "G3", "C", "three")],
        SCHEMA,
    )
    idx = TextIndex.build(files, 4).write(path)
    before_other = [r for r in frag_set(idx) if r[0] == 2]

    change = spark.createDataFrame([(1, "g1", "G1", "A", "a new text of five words")], SCHEMA)
    idx = apply_changes(idx, path, changes=change)
    rows = [r for r in frag_set(idx) if r[0] == 1]
    assert [r[1] for r in rows] == [1, 2]  # old fragments gone, new numbered from 1
    assert rows[0][2] == ("a", "new", "text", "of")
    assert [r for r in frag_set(idx) if r[0] == 2] == before_other  # other books untouched

    once = frag_set(idx)
    idx = apply_changes(idx, path, changes=change)  # same batch twice = once
    assert frag_set(idx) == once  # (a loaded handle lists its files: use the returned one)

    # deleting the only book of bucket 1 leaves that bucket empty
    idx = apply_changes(idx, path, deleted_ids=spark.createDataFrame([(1,)], "file_id long"))
    assert idx.files.filter("bucket = 1").count() == 0
    assert idx.postings.filter("file_id = 1").count() == 0

    expected = files.filter("file_id <> 1")
    rebuilt = TextIndex.build(expected, 4)
    assert frag_set(idx) == frag_set(rebuilt)
    from quire.operators.analyze import postings

    assert post_set(idx) == sorted(tuple(r) for r in postings(rebuilt.fragments).collect())


def test_lazy_upkeep(spark):
    files = spark.createDataFrame([(1, "g1", "G1", "A", G1), (2, "g2", "G2", "B", "x y")], SCHEMA)
    idx = TextIndex.build(files, 8)
    v2 = spark.createDataFrame(
        [(1, "g1", "G1", "A", "old", 1), (1, "g1", "G1", "A", "newest text", 2)], SCHEMA + ", version int"
    )
    up = upsert(idx, v2, order_col="version")
    assert [tuple(r.content_array) for r in up.fragments.filter("file_id = 1").collect()] == [("newest", "text")]
    assert delete(idx, spark.createDataFrame([(2,)], "file_id long")).fragments.select("file_id").distinct().count() == 1
    assert clear(idx).files.count() == 0 and clear(idx).fragments.count() == 0


def test_stream_two_drops_equals_batch(spark, tmpdir_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src = os.path.join(tmpdir_path, "in")
    first = docs.filter("doc_id < 100")
    second = docs.filter("doc_id >= 100").unionByName(
        docs.filter("doc_id < 5").withColumn("text", F.concat(F.lit("changed "), "text"))
    )
    first.write.parquet(os.path.join(src, "drop1"))
    path, ckpt = os.path.join(tmpdir_path, "index"), os.path.join(tmpdir_path, "ckpt")
    q = start_index_feed(spark, os.path.join(src, "*"), path, ckpt, max_tokens=50)
    q.awaitTermination()
    second.write.parquet(os.path.join(src, "drop2"))
    q = start_index_feed(spark, os.path.join(src, "*"), path, ckpt, max_tokens=50)
    q.awaitTermination()
    streamed = TextIndex.load(spark, path, max_tokens=50)

    final_docs = docs.filter("doc_id >= 5").unionByName(
        docs.filter("doc_id < 5").withColumn("text", F.concat(F.lit("changed "), "text"))
    )
    batch = TextIndex.build(files_from_documents(final_docs), 50)
    assert frag_set(streamed) == frag_set(batch)


BOOK = (
    "Title: {t}\r\nAuthor: {a}\r\n\r\n*** START OF THE PROJECT GUTENBERG EBOOK {T} ***\r\n"
    "{body}\r\n*** END OF THE PROJECT GUTENBERG EBOOK {T} ***\r\n"
)


def test_book_file_feed(spark, tmpdir_path):
    """Book files arrive in two drops; a re-delivered file keeps its id and
    replaces its text, a new file gets the next id, a bad file is rejected."""
    import time

    from quire.plans.search import search_files
    from quire.streaming.feed import start_book_feed

    src, path, ckpt = (os.path.join(tmpdir_path, x) for x in ("books", "index", "ckpt"))
    folder = {"now": "drop1"}

    def drop(name, text):
        d = os.path.join(src, folder["now"])
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)

    drop("a.txt", BOOK.format(t="Sea", a="Ann", T="SEA", body="the old man and the sea"))
    drop("b.txt", BOOK.format(t="Whale", a="Bo", T="WHALE", body="a whale"))
    drop("bad.txt", "no header at all")
    start_book_feed(spark, src + "/*", path, ckpt, max_tokens=8, buckets=4).awaitTermination()
    idx = TextIndex.load(spark, path)
    assert sorted((r.file_id, r.filename) for r in idx.files.collect()) == [(1, "a.txt"), (2, "b.txt")]

    time.sleep(1.1)  # a later modification time
    folder["now"] = "drop2"  # a file source reads each path once: new versions come as new paths
    drop("a.txt", BOOK.format(t="Sea", a="Ann", T="SEA", body="an old whale"))
    drop("c.txt", BOOK.format(t="Sky", a="Cy", T="SKY", body="old sky"))
    start_book_feed(spark, src + "/*", path, ckpt, max_tokens=8, buckets=4).awaitTermination()
    idx = TextIndex.load(spark, path)
    assert sorted((r.file_id, r.filename) for r in idx.files.collect()) == [(1, "a.txt"), (2, "b.txt"), (3, "c.txt")]
    hits = {r.file_id for r in search_files(idx, "old & whale", "logical").collect()}
    assert hits == {1}
    assert search_files(idx, "old <-> man", "logical").count() == 0  # old text of a.txt is gone
    rejected = spark.read.parquet(os.path.join(path, "_rejects")).collect()
    assert [os.path.basename(r.path) for r in rejected] == ["bad.txt"]


def test_written_bytes_grow_with_the_batch(spark, tmpdir_path):
    """A change appends its own rows; searches and compaction see them as a rebuild."""
    from quire.operators.upkeep import compact
    from quire.plans.search import search_files
    from quire.sources.corpus import corpus_files

    path = os.path.join(tmpdir_path, "idx")
    files = corpus_files(spark, "/root/testdata/sf0.001")
    first = TextIndex.build(files, 60).write(path, buckets=4)

    def size(version):
        return sum(os.path.getsize(os.path.join(d, f)) for t in ("files", "fragments", "postings") for d, _, fs in os.walk(os.path.join(path, t, f"version={version}")) for f in fs)

    change = files.filter("file_id = 7").withColumn("content", F.lit("whales of the sea"))
    idx = apply_changes(first, path, changes=change, deleted_ids=spark.createDataFrame([(9,)], "file_id long"))
    assert 0 < size(1) < size(0) / 20
    assert first.fragments.filter("file_id = 9").count() > 0  # a loaded index keeps showing its version
    rebuilt = TextIndex.build(files.filter("file_id not in (7, 9)").unionByName(change), 60)
    for now in (idx, compact(idx, path)):
        assert frag_set(now) == frag_set(rebuilt)
        for strategy in ("ts_fast_headline", "ts_semantic_headline"):
            want = sorted(map(tuple, search_files(rebuilt, "of <-> the", "logical", strategy).collect()))
            assert sorted(map(tuple, search_files(now, "of <-> the", "logical", strategy).collect())) == want
    assert TextIndex.load(spark, path).version == 2
    # a version without its marker does not count
    os.makedirs(os.path.join(path, "changed", "version=3"), exist_ok=True)
    files.select("file_id").write.mode("overwrite").parquet(os.path.join(path, "changed", "version=3"))
    assert frag_set(TextIndex.load(spark, path)) == frag_set(rebuilt)


def test_two_versions_without_an_order_fail(spark):
    import pytest

    idx = TextIndex.build(spark.createDataFrame([(1, "g1", "G1", "A", G1)], SCHEMA), 8)
    twice = spark.createDataFrame([(1, "g1", "G1", "A", "x"), (1, "g1", "G1", "A", "y")], SCHEMA)
    with pytest.raises(Exception, match="two versions of one book"):
        upsert(idx, twice).fragments.collect()
