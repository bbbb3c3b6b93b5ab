"""A written index under several writers, and what each kind of change costs."""

import os

from pyspark.sql import functions as F

from quire.operators import upkeep
from quire.operators.upkeep import apply_changes, compact, empty, kinds_of_change
from quire.plans.index import TextIndex

SCHEMA = "file_id long, filename string, title string, author string, content string"


def books(spark, *rows):
    return spark.createDataFrame([(i, f"{i}.txt", title, "A", text) for i, title, text in rows], SCHEMA)


def shown(index):
    return sorted((r.file_id, r.title, " ".join(r.content_array)) for r in index.fragments.collect())


def words(index):
    return sorted((r.lexeme, r.file_id, r.pos) for r in index.postings.collect())


def test_two_writers_keep_both_books(spark, tmpdir_path, monkeypatch):
    path = os.path.join(tmpdir_path, "idx")
    idx = TextIndex.build(books(spark, (1, "T", "old man")), 8).write(path, buckets=2)
    real, other = upkeep.commit, []

    def slow(*args):
        if not other:  # while the first writer is about to commit, a second one does
            other.append(1)
            apply_changes(idx, path, changes=books(spark, (60, "T", "second writer"), (1, "T", "new man")))
        return real(*args)

    monkeypatch.setattr(upkeep, "commit", slow)
    now = apply_changes(idx, path, changes=books(spark, (50, "T", "first writer")))
    want = [(1, "T", "new man"), (50, "T", "first writer"), (60, "T", "second writer")]
    assert shown(now) == want and now.version == 2
    other.clear()
    folded = compact(now, path)  # and a writer between a compaction's read and its commit
    assert shown(folded) == sorted([(1, "T", "new man"), *want[1:]]) and folded.version == 4


def test_each_kind_of_change_writes_what_it_must(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "idx")
    text = "the whale and the sea " * 200
    first = books(spark, *[(i, f"T{i}", f"{text} book{i}") for i in range(8)])
    idx = TextIndex.build(first, 100).write(path, buckets=2)

    def size(name, version):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(path, name, f"version={version}")) for f in fs if f.endswith(".parquet"))

    same = first.filter("file_id = 1")
    fields = first.filter("file_id = 2").withColumn("title", F.lit("Renamed"))
    changed = first.filter("file_id = 3").withColumn("content", F.lit("short"))
    new = books(spark, (20, "T20", "a new book"))
    batch = same.unionByName(fields).unionByName(changed).unionByName(new)
    assert {r.file_id: r.kind for r in kinds_of_change(idx, batch).collect()} == {1: "same", 2: "fields", 3: "text", 20: "new"}

    now = apply_changes(idx, path, changes=same)
    assert size("files", 1) == size("fragments", 1) == size("postings", 1) == 0 and shown(now) == shown(idx)
    now = apply_changes(now, path, changes=fields)
    assert size("postings", 2) == 0 and size("fragments", 2) > 0
    assert {r.title for r in now.fragments.filter("file_id = 2").collect()} == {"Renamed"}
    assert words(now) == words(idx)
    now = apply_changes(now, path, changes=batch)
    want = first.filter("file_id not in (2, 3)").unionByName(fields).unionByName(changed).unionByName(new)
    rebuilt = TextIndex.build(want, 100).write(os.path.join(tmpdir_path, "other"), buckets=2)
    for x in (now, compact(now, path)):
        assert shown(x) == shown(rebuilt) and words(x) == words(rebuilt)
    assert now.counts(["whale"])["whale"] >= rebuilt.counts(["whale"])["whale"]


def test_emptied(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "idx")
    idx = empty(TextIndex.build(books(spark, (1, "T", "old man"), (2, "T", "sea")), 8).write(path, buckets=2), path)
    assert [t.count() for t in (idx.files, idx.fragments, idx.postings, idx.lexicon)] == [0, 0, 0, 0]
    assert shown(apply_changes(idx, path, changes=books(spark, (3, "T", "again")))) == [(3, "T", "again")]


def test_fragments_are_made_where_they_are_written(spark, tmpdir_path):
    """Texts are dealt out, not fragments; an index of many books has many write tasks; and
    what the newest version wrote is shown without a join."""
    from quire.plans import index as plans

    first = books(spark, *[(i, f"T{i}", f"walking walks walked the sea {i} " * 30) for i in range(40)])
    for config in ("simple", "english"):
        path = os.path.join(tmpdir_path, config)
        idx = TextIndex.build(first, 10, config)
        joins = idx.hit_lists(["walk"])._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in joins and "Exchange" not in joins
        was = idx.write(path, buckets=2)
        now = apply_changes(was, path, changes=first.filter("file_id < 3").withColumn("content", F.lit("the sea")))
        assert shown(was) == shown(idx) and {r for r in words(now) if r[1] > 2} == {r for r in words(was) if r[1] > 2}
        assert [r for r in shown(now) if r[0] < 3] == [(i, f"T{i}", "the sea") for i in range(3)]
    assert plans.text_bytes(first) > 0 and plans.text_bytes(first.limit(0)) == 0


def test_a_book_that_comes_twice_is_found(spark, tmpdir_path):
    from quire.operators.query import compile_query
    from quire.plans.search import match

    twice = books(spark, *[(1, "T", "walks by the sea")] * 2, (2, "U", "he walked"))
    lazy = TextIndex.build(twice, 10, "english")
    for idx in (lazy, lazy.write(os.path.join(tmpdir_path, "idx"), buckets=2)):
        spans, _ = match(idx, compile_query(spark, "walk", "logical", "english"))
        assert sorted((r.file_id, r.s, r.e) for r in spans.collect()) == [(1, 1, 1), (1, 1, 1), (2, 2, 2)]
