"""What a whole-book search may cost: the hits are read and shuffled once for both levels."""

import pytest

from quire.plans.index import TextIndex
from quire.plans.search import search_full

FIELDS = "file_id long, filename string, title string, author string, content string"
ROWS = [
    (1, "s/1.txt", "T1", "s", "one of the words with this end"),
    (2, "s/2.txt", "T2", "s", "nothing here"),
    (2, "s/2.txt", "T2", "s", "the other with the same id"),
    (3, "s/3.txt", "T3", "s", None),
    (None, "s/4.txt", "T4", "s", "of the this"),
]


@pytest.mark.parametrize(("query", "semantic", "found"), [("with | !the", False, {1, 2}), ("(of <-> the) & words", True, {1})])
def test_hits_are_analysed_once(spark, tmpdir_path, query, semantic, found):
    spark.createDataFrame(ROWS, FIELDS).write.mode("overwrite").parquet(tmpdir_path)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan shows reuse before it runs
    try:
        heads = search_full(TextIndex.build(spark.read.parquet(tmpdir_path), 4), query, semantic=semantic)
        plan = heads._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # the hits, the layout, the tokens; a negation asks for all fragments too
    assert plan.count("FileScan") == 3 + ("!" in query)
    assert {r.file_id for r in heads.collect()} == found
