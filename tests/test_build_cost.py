"""What an index build may cost: no shuffle of postings, no expression per token."""

from pyspark.sql import DataFrame

from quire.functions import revised, stem
from quire.operators.analyze import fragments, position_lists
from quire.plans.index import SPLIT_BYTES, TextIndex

FIELDS = "file_id long, filename string, title string, author string, content string"


def books(spark, n=6):
    rows = [(i, f"s/{i}.txt", f"T{i}", "s", f"T{i}\nrunning runs, ran-{i} -- The ({i % 2}) skies said runs") for i in range(n)]
    return spark.createDataFrame(rows, FIELDS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_written_without_a_shuffle(spark, tmpdir_path, monkeypatch):
    dealt, deal = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, *a: (dealt.append((self.columns, a)), deal(self, *a))[1])
    before = spark.conf.get(SPLIT_BYTES)
    idx = TextIndex.build(books(spark), 3, "english").write(tmpdir_path, buckets=2)
    assert not [a for columns, a in dealt if "positions" in columns]
    assert spark.conf.get(SPLIT_BYTES) == before
    want = position_lists(fragments(books(spark), 3), config="english")
    assert sorted(map(str, idx.lists.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_position_lists_without_expressions_per_token(spark):
    fr = fragments(books(spark), 4)
    for config in ("simple", "english", "english_revised"):
        plan = plan_of(position_lists(fr, config=config))
        assert "Exchange" not in plan and "lambdafunction" not in plan.split("MapInArrow")[0]
    found = {(r.lexeme, r.file_id, r.sequence_no): r.positions for r in position_lists(fragments(books(spark, 1), None), config="english").collect()}
    assert found[("run", 0, 1)] == [2, 3, 9]
    assert not [k for k in found if k[0] == "the"]


def test_stems_by_last_letter_hold_every_rule():
    for module, steps in ((stem, (stem.STEP_1A, stem.STEP_2, stem.STEP_3, stem.STEP_4)), (revised, (revised.STEP_0, revised.STEP_2, revised.STEP_3, revised.STEP_4))):
        for rules in steps:
            dealt = stem.by_last_letter(rules)
            assert sorted(r for of in dealt.values() for r in of) == sorted(rules)
            assert all(r[0][-1:] == letter for letter, of in dealt.items() for r in of)
