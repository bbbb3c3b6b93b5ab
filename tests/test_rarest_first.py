"""Position lists, rarest-word-first reads, file skipping, pieces that do not overlap."""

import pytest
from pyspark.sql import functions as F

from quire.operators.analyze import fragments, lexicon, occurrences, position_lists, postings
from quire.operators.headline import apart_covers
from quire.operators.query import compile_query, pivot
from quire.plans.index import TextIndex
from quire.plans.search import match, search_files

BOOKS, RARE = 400, (3, 170, 388)
FILES = "file_id long, filename string, title string, author string, content string"


def books(spark, rows):
    return spark.createDataFrame([(i, f"{i}.txt", f"T{i}", "A", text) for i, text in rows], FILES)


@pytest.fixture(scope="module")
def corpus(spark):
    text = lambda i: f"of the sea of {'whale ' if i in RARE else ''}book{i} zebra aardvark and of the end"
    return books(spark, [(i, text(i)) for i in range(BOOKS)])


@pytest.fixture(scope="module")
def written(spark, corpus, tmp_path_factory):
    return TextIndex.build(corpus).write(str(tmp_path_factory.mktemp("index") / "x"), buckets=256)


def leaves(df):
    """The file scans of an executed plan."""
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == "FileSourceScanExec":
            out.append(p)
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    return out


def rows_read(df):
    df.collect()
    return sum(p.metrics().apply("numOutputRows").value() for p in leaves(df))


def test_lists_hold_the_same_postings(spark, corpus):
    for config in ("simple", "english"):
        fr = fragments(corpus.filter("file_id < 20"), 5, config)
        want = sorted(map(tuple, postings(fr, config=config).collect()))
        lists = position_lists(fr, config=config)
        assert sorted(tuple(r) for r in occurrences(lists).drop("word_offset").collect()) == want
        assert all(r.positions == sorted(set(r.positions)) for r in lists.collect())
        some = sorted({w for w, *_ in want})[:3]
        assert sorted(tuple(r) for r in occurrences(position_lists(fr, some, config)).drop("word_offset").collect()) == [p for p in want if p[0] in some]
        assert position_lists(fr, [], config).count() == 0
        assert {r.lexeme: r.n_fragments for r in lexicon(lists).collect()} == {w: len({p[1:3] for p in want if p[0] == w}) for w in {p[0] for p in want}}


def test_pivots(spark):
    counts = {"of": 400, "the": 400, "whale": 3, "sea": 400, "end": 50}
    of = lambda text, mode="logical": pivot(compile_query(spark, text, mode).root, counts)
    assert of("of & whale") == (3, {"whale"})
    assert of("of the whale", "phrase") == (3, {"whale"})
    assert of("whale | (of & end)") == (53, {"whale", "end"})
    assert of("of <2> !whale") == (400, {"of"})
    assert of("!whale") is None and of("of | !whale") is None
    assert of("of & !whale") == (400, {"of"})
    assert of("of & nowhere") == (0, {"nowhere"})


@pytest.mark.parametrize("text,mode", [("of the sea of whale", "phrase"), ("whale | (of & book7)", "logical"), ("(of <4> whale) & the", "logical")])
def test_rows_are_those_of_a_full_read(written, corpus, text, mode):
    lazy = TextIndex.build(corpus)
    rows = lambda idx, i: sorted(tuple(r) for r in match(idx, compile_query(idx.spark, text, mode))[i].collect())
    assert rows(written, 0) == rows(lazy, 0) and rows(written, 1) == rows(lazy, 1)
    for strategy in ("ts_fast_headline", "ts_semantic_headline"):
        got, want = (sorted(map(tuple, search_files(idx, text, mode, strategy).collect())) for idx in (written, lazy))
        assert got == want


def test_frequent_words_are_read_for_the_rare_fragments_only(spark, written):
    q = compile_query(spark, "of & the & whale", "logical")
    lists = written.match_lists(q)
    assert sorted((r.lexeme, r.file_id) for r in lists.collect()) == sorted((w, i) for w in ("of", "the", "whale") for i in RARE)
    plan = lists._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LeftSemi" in plan and "BroadcastExchange" in plan and "dynamicpruning" in plan.lower()
    both = written.match_lists(compile_query(spark, "of & the", "logical"))
    assert both.count() == 2 * BOOKS  # nothing to gain: read as they are


def test_a_rare_word_skips_files(spark, written):
    files = written.lists.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.max(F.col("lexeme") == "whale").alias("holds"))
    sizes = files.collect()
    assert len(sizes) >= 200
    held = sum(r.n for r in sizes if r.holds)
    hits = written.hit_lists(["whale"])
    # every file's range (aardvark .. zebra) covers the word; only those that hold it are read
    assert hits.count() == len(RARE) and rows_read(written.hit_lists(["whale"])) <= held
    assert rows_read(written.hit_lists(["quokka"])) == 0


def test_pieces_do_not_overlap(spark):
    fill = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    text = f"{fill(30, 'a')} whale x sea y whale z sea {fill(60, 'b')} whale sea {fill(30, 'c')}"
    idx = TextIndex.build(books(spark, [(1, text), (2, "sea whale " * 200)]))
    for strategy in ("ts_fast_headline", "ts_headline", "ts_semantic_headline"):
        got = {r.file_id: r.headline for r in search_files(idx, "whale & sea", "logical", strategy).collect()}
        pieces = got[1].split(" ... ")
        assert len(pieces) == 2 and sum("x <b>sea</b>" in p for p in pieces) == 1
        assert len(got[2].split(" ... ")) == 5  # five apart from each other among hundreds of equal covers


def test_choice_equals_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    rows = []
    for f in range(6):
        for q in (1, 2):
            s = 0
            for _ in range(rng.choice([0, 3, 40, 200])):
                s += rng.randint(1, 6)
                e = s + rng.randint(0, 50)
                rows.append((f, q, s, e, 16 / max(16, e - s + 1)))
        if f % 3 == 0:
            rows.append((f, 3, None, None, None))

    def window(s, e):
        n = e - s + 1
        a = s if n >= 15 else s - (15 - n) // 2
        return max(1, a), (min(e, s + 34) if n >= 15 else a + 14)

    want = []
    for f in range(6):
        mine = sorted((r for r in rows if r[0] == f), key=lambda r: (r[4] is not None, -(r[4] or 0), 0 if r[2] is None else r[3] - r[2], r[1], r[2] or 0))
        taken = []
        for _, q, s, e, _ in mine:
            if len(taken) < 5 and (s is None or not any(t[1] is not None and t[0] == q and window(*t[1:])[0] <= window(s, e)[1] and window(s, e)[0] <= window(*t[1:])[1] for t in taken)):
                taken.append((q, s, e))
        want += [(f, *t, i + 1) for i, t in enumerate(taken)]
    df = spark.createDataFrame(rows, "file_id long, sequence_no int, s int, e int, density double")
    got = sorted(((r.file_id, r.sequence_no, r.s, r.e, r.rn) for r in apart_covers(df).collect()), key=lambda r: (r[0], r[4]))
    assert got == want
