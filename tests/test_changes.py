"""A feed of typed changes: the index equals one built from the books that are left."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators.analyze import postings
from quire.plans.index import TextIndex
from quire.streaming.changes import EVENT_SCHEMA, event_batches, start_change_feed

FILES = "file_id long, filename string, title string, author string, content string"


def event(op, book, seq, text=None):
    return (op, book, seq, f"{book}.txt", f"T{seq}", "A", text)


def state(index):
    frags = sorted((r.file_id, r.sequence_no, r.title, tuple(r.content_array)) for r in index.fragments.collect())
    return frags, sorted((r.lexeme, r.file_id, r.sequence_no, r.pos) for r in index.postings.collect())


def rebuilt(spark, events):
    """A full build from the event of each book with the largest number."""
    last = {}
    for e in events:
        if e[1] not in last or e[2] > last[e[1]][2]:
            last[e[1]] = e
    files = spark.createDataFrame([(e[1], *e[3:]) for e in last.values() if e[0] != "delete"], FILES)
    index = TextIndex.build(files, 4)
    frags = sorted((r.file_id, r.sequence_no, r.title, tuple(r.content_array)) for r in index.fragments.collect())
    return frags, sorted((r.lexeme, r.file_id, r.sequence_no, r.pos) for r in postings(index.fragments).collect())


def test_batches_in_any_order_equal_a_rebuild(spark, tmpdir_path):
    """Inserts, updates, deletes and late older updates over batches, each batch given twice."""
    path, rng = os.path.join(tmpdir_path, "idx"), random.Random(5)
    events = [event("insert", b, 1, f"the old man {b} and the sea") for b in range(8)]
    for seq in range(2, 5):
        for b in rng.sample(range(8), 5):
            op = rng.choice(["update", "update", "delete"])
            events.append(event(op, b, seq, None if op == "delete" else f"whale {b} {seq} x y z"))
    rng.shuffle(events)
    run = event_batches(path, max_tokens=4, buckets=3)
    for k in range(3):
        batch = spark.createDataFrame(events[k::3], EVENT_SCHEMA)
        run(batch, k)
        run(batch, k)  # replayed after a failure
    assert state(TextIndex.load(spark, path, max_tokens=4)) == rebuilt(spark, events)


def test_feed_over_files(spark, tmpdir_path):
    """A late update does not bring a deleted book back; a newer insert does."""
    path, drops, ck = (os.path.join(tmpdir_path, x) for x in ("idx", "in", "ck"))
    days = [
        [event("insert", 1, 1, "a b c"), event("insert", 2, 1, "d e"), event("insert", 3, 1, "f")],
        [event("delete", 1, 5), event("update", 2, 3, "new text"), event("delete", 3, 2)],
        [event("update", 1, 4, "late"), event("update", 2, 2, "late"), event("insert", 3, 9, "back again")],
    ]
    for day in days:
        rows = spark.createDataFrame(day, EVENT_SCHEMA).withColumn("bucket", F.lit("clash")).coalesce(1)
        rows.write.mode("append").parquet(drops)
        start_change_feed(spark, drops, path, ck, max_tokens=4, buckets=2).awaitTermination()
    index = TextIndex.load(spark, path, max_tokens=4)
    assert sorted((r.file_id, r.content) for r in index.files.collect()) == [(2, "new text"), (3, "back again")]
    assert state(index) == rebuilt(spark, [e for day in days for e in day])


def test_ties_rejects_and_empty_batch(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "idx")
    run = event_batches(path, max_tokens=4, buckets=2)
    run(spark.createDataFrame([], EVENT_SCHEMA), 0)
    assert state(TextIndex.load(spark, path)) == ([], [])
    good = [event("insert", 1, 1, "a"), event("update", 1, 1, "b"), event("update", 1, 1, "b"), event("insert", 2, 1, "c"), event("delete", 2, 1), event("insert", 3, 1, "")]
    bad = [event("insert", None, 1, "a"), event("insert", 4, None, "a"), event("move", 4, 1, "a"), event(None, 4, 1, "a"), event("insert", 4, 1)]
    run(spark.createDataFrame(good + bad, EVENT_SCHEMA), 1)
    run(spark.createDataFrame([event("update", 1, 1, "same number, later batch")], EVENT_SCHEMA), 2)
    assert sorted((r.file_id, r.content) for r in TextIndex.load(spark, path).files.collect()) == [(1, "b"), (3, "")]
    assert spark.read.parquet(os.path.join(path, "events_rejected")).count() == len(bad)
    with pytest.raises(ValueError):
        event_batches(path, max_tokens=4, buckets=2, strict=True)(spark.createDataFrame(bad, EVENT_SCHEMA), 3)
