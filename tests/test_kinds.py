"""A batch is judged by ids, fields and digests: its texts do not travel."""

from pyspark.sql import functions as F

from quire.operators.upkeep import kinds_of_change
from quire.plans.index import TextIndex
from tests.test_build_cost import books


def test_texts_do_not_travel_to_be_judged(spark, tmpdir_path):
    idx = TextIndex.build(books(spark), 3).write(tmpdir_path, buckets=2)
    batch = books(spark, 3).withColumn("title", F.when(F.col("file_id") == 1, "new").otherwise(F.col("title")))
    kinds = kinds_of_change(idx, batch)
    assert kinds.columns == ["file_id", "kind"]
    assert dict(kinds.collect()) == {0: "same", 1: "fields", 2: "same"}
