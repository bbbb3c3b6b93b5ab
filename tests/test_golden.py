"""Hand-computed golden cases (FIXTURES.md, `simple` configuration)."""

import pytest

from quire.operators.analyze import fragments
from quire.operators.match import covers
from quire.plans.index import TextIndex
from quire.plans.search import file_matches, match, search_files
from quire.operators.query import compile_query

G1 = "the old man and the sea was old"
G2 = "Whale hunting,\r\n\r\nthe OLD whale"
G3 = "whale one two three four five six seven eight nine"


@pytest.fixture(scope="module")
def golden(spark):
    files = spark.createDataFrame(
        [(1, "g1.txt", "G1", "A", G1), (2, "g2.txt", "G2", "B", G2), (3, "g3.txt", "G3", "C", G3)],
        "file_id long, filename string, title string, author string, content string",
    )
    f8 = fragments(files.filter("file_id < 3"), 8)
    f5 = fragments(files.filter("file_id = 3"), 5)
    return TextIndex(files, f8.unionByName(f5))


def spans_of(index, text, mode):
    q = compile_query(index.spark, text, mode)
    if q.empty:
        return set()
    spans, frags = match(index, q)
    return {(r.file_id, r.sequence_no, r.s, r.e) for r in spans.collect()}, {
        r.file_id for r in frags.collect()
    }


def test_fragments_and_positions(golden):
    rows = {(r.file_id, r.sequence_no): r for r in golden.fragments.collect()}
    assert [x.lexeme for x in rows[(1, 1)].content_tsv] == "the old man and the sea was old".split()
    assert rows[(2, 1)].content_array[1] == "hunting,"
    assert [x.lexeme for x in rows[(2, 1)].content_tsv] == ["whale", "hunting", "the", "old", "whale"]
    assert rows[(3, 1)].content_array == ["whale", "one", "two", "three", "four"]
    assert [x.pos for x in rows[(3, 2)].content_tsv] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize(
    "text,mode,files,spans",
    [
        ("old man", "phrase", {1}, {(1, 1, 2, 3)}),
        ("old whale", "phrase", {2}, {(2, 1, 4, 5)}),
        ("four five", "phrase", set(), set()),
        ("whale & nine", "logical", set(), set()),
        ("old <2> and", "logical", {1}, {(1, 1, 2, 4)}),
        ("old <1> and", "logical", set(), set()),
        ("old <1> !man", "logical", {1, 2}, {(1, 1, 8, 8), (2, 1, 4, 4)}),
        ("old & !whale", "logical", {1}, {(1, 1, 2, 2), (1, 1, 8, 8)}),
    ],
)
def test_match_golden(golden, text, mode, files, spans):
    got_spans, got_files = spans_of(golden, text, mode)
    assert got_files == files
    assert got_spans == spans


def test_not_and_or(golden):
    _, files = spans_of(golden, "!whale", "logical")
    assert files == {1, 3}
    _, files = spans_of(golden, "old & (sea | whale)", "logical")
    assert files == {1, 2}


def test_empty_and_errors(golden):
    assert search_files(golden, "", "logical").count() == 0
    with pytest.raises(ValueError):
        compile_query(golden.spark, "a &", "logical")
    with pytest.raises(ValueError):
        search_files(golden, "a", "fuzzy")
    with pytest.raises(ValueError):
        search_files(golden, "a", "logical", "x")


def test_covers_golden(golden):
    for text, want in [("old & sea", {(2, 6, 1.0), (6, 8, 1.0)}), ("(old <1> man) & sea", {(2, 6, 1.0)})]:
        q = compile_query(golden.spark, text, "logical")
        spans, _ = match(golden, q)
        got = {(r.s, r.e, r.density) for r in covers(spans.filter("file_id = 1"), q).collect()}
        assert got == want, text


def test_headline_marks(golden):
    fast = {r.file_id: r.headline for r in search_files(golden, "old man", "phrase").collect()}
    assert "<b>old man</b>" in fast[1]
    sem = {r.file_id: r.headline for r in search_files(golden, "old man", "phrase", "ts_semantic_headline").collect()}
    assert "<b>old man</b>" in sem[1]
    built = {r.file_id: r.headline for r in search_files(golden, "old man", "phrase", "ts_headline").collect()}
    assert "<b>old</b> <b>man</b>" in built[1]


def test_shorter_cover_first(golden):
    head = search_files(golden, "old & sea", "logical").filter("file_id = 1").first().headline
    # covers [2,6] and [6,8], both widened to the whole fragment: pieces do not overlap,
    # so the better one is shown alone
    assert head == "the <b>old</b> man and the <b>sea</b> was <b>old</b>"


def test_negation_only_lists_book_without_headline(golden):
    rows = {r.file_id: r.headline for r in search_files(golden, "!whale", "logical").collect()}
    assert set(rows) == {1, 3}
    assert rows[1] is None and rows[3] is None


def test_file_matches(golden):
    terms = sorted(r.term for r in file_matches(golden, "old <1> !man", "logical", 1).collect())
    assert terms == ["old"]
    terms = sorted(r.term for r in file_matches(golden, "old man", "phrase", 1).collect())
    assert terms == ["old man"]


def test_bucketed_tables_same_results(spark, tmpdir_path):
    """The catalog-table layout (bucketed by file_id, no shuffle of hits) and the
    path layout give the same answers as the in-plan index."""
    from quire.sources.corpus import corpus_files

    files = corpus_files(spark, "/root/testdata/sf0.001")
    lazy = TextIndex.build(files, 60)
    tables = lazy.write_tables("golden_t", buckets=4, path=tmpdir_path + "/tables")
    written = lazy.write(tmpdir_path + "/paths")
    assert tables.co_partitioned
    for text, mode, strategy in [
        ("(of <-> the) | (was & with)", "logical", "ts_fast_headline"),
        ("of the", "phrase", "ts_semantic_headline"),
        ("and & !the", "logical", "ts_fast_headline"),
        ("the <2> of", "logical", "ts_headline"),
    ]:
        want = sorted(tuple(r) for r in search_files(lazy, text, mode, strategy).collect())
        assert want, text
        for idx in (tables, written):
            got = sorted(tuple(r) for r in search_files(idx, text, mode, strategy).collect())
            assert got == want, (text, strategy)
    want = sorted(tuple(r) for r in file_matches(lazy, "of <-> the", "logical").collect())
    assert sorted(tuple(r) for r in file_matches(tables, "of <-> the", "logical").collect()) == want


@pytest.mark.parametrize(
    "text,spans",
    [
        ("(old | sea) <1> was", {(1, 1, 6, 7)}),  # sea6 was7; old2 man3, old8 end
        ("(old & sea) <1> was", {(1, 1, 6, 7)}),  # AND spans inside a distance operand
        ("!was <1> old", {(1, 1, 2, 2)}),  # old8 follows was7, old2 follows the1
        ("!old <1> man", set()),
        ("the <-> old <-> man", {(1, 1, 1, 3)}),  # chain of three words
        ("(the <-> old) <2> and", {(1, 1, 1, 4)}),
    ],
)
def test_distance_shapes(golden, text, spans):
    got, _ = spans_of(golden, text, "logical")
    assert {s for s in got if s[0] == 1} == spans


def test_query_grammar_errors(golden):
    for bad in ["a &", "(a | b", "a <x> b", "!a <1> !b", "a | <1> b", ")", "whale:*"]:
        with pytest.raises(ValueError):
            compile_query(golden.spark, bad, "logical")
    assert compile_query(golden.spark, "   ", "logical").empty
    assert compile_query(golden.spark, "... ---", "phrase").empty


def test_full_headline_without_cover_shows_first_words(golden):
    for strategy in ("ts_headline", "ts_semantic_headline"):
        rows = {r.file_id: r.headline for r in search_files(golden, "!whale", "logical", strategy).collect()}
        assert rows == {1: G1, 3: G3}, strategy  # G3 spans two fragments: gathered in order


def test_full_headline_crosses_fragment_border(golden):
    # G3 is cut after 'four'; the whole-book headline still finds the phrase across the border
    rows = {r.file_id: r.headline for r in search_files(golden, "four five", "phrase", "ts_semantic_headline").collect()}
    assert rows == {}  # no fragment matches, so the book is not listed (matching is per fragment)
    rows = {r.file_id: r.headline for r in search_files(golden, "whale & (four <-> five)", "logical", "ts_semantic_headline").collect()}
    assert rows == {}
    rows = {r.file_id: r.headline for r in search_files(golden, "whale | nine", "logical", "ts_headline").collect()}
    # two covers [1,1] and [10,10], widened evenly to 15 words ([-6,8] and [3,17]) and
    # clipped to the book's 10 words: they overlap, so the first of these equals stands alone
    assert rows[3] == "<b>whale</b> one two three four five six seven"


def test_attach_tables_in_a_fresh_catalog(spark, tmpdir_path):
    from quire.sources.corpus import corpus_files

    lazy = TextIndex.build(corpus_files(spark, "/root/testdata/sf0.001"), 60)
    first = lazy.write_tables("attach_a", buckets=4, path=tmpdir_path + "/t")
    for t in ("files", "fragments", "postings"):  # forget the catalog entries, keep the data
        spark.sql(f"DROP TABLE attach_a_{t}")
    again = TextIndex.attach_tables(spark, "attach_a", tmpdir_path + "/t")
    assert again.co_partitioned and again.max_tokens == 60
    want = sorted(tuple(r) for r in search_files(lazy, "of <-> the", "logical").collect())
    assert sorted(tuple(r) for r in search_files(again, "of <-> the", "logical").collect()) == want
    del first


def test_layouts_agree_and_planning_runs_no_job(spark, tmpdir_path):
    """One lazy plan: building a search runs nothing but the look-up of words that the
    index was not asked for before."""
    from quire.plans.search import search_fast, search_full
    from quire.sources.corpus import corpus_files

    lazy = TextIndex.build(corpus_files(spark, "/root/testdata/sf0.001"), 60)
    layouts = [lazy.write(tmpdir_path + "/p"), lazy.write_tables("prune_t", buckets=4, path=tmpdir_path + "/t")]
    sc = spark.sparkContext
    for text in ["(of <-> the) | (was & with)", "with | !the"]:
        want = sorted(tuple(r) for r in search_fast(lazy, text).collect())
        want_full = sorted(tuple(r) for r in search_full(lazy, text, semantic=True).collect())
        for idx in layouts:
            idx.counts(["of", "the", "was", "with"])
            group = f"plan-{idx.co_partitioned}-{len(text)}"
            sc.setJobGroup(group, "planning only")
            fast, full = search_fast(idx, text), search_full(idx, text, semantic=True)
            assert list(sc.statusTracker().getJobIdsForGroup(group)) == []
            sc.setJobGroup("run", "")
            assert sorted(tuple(r) for r in fast.collect()) == want
            assert sorted(tuple(r) for r in full.collect()) == want_full


def test_blanks_are_the_same_for_text_and_query(spark):
    nb = "of\u00a0the"  # a no-break space parts no words, on either side
    files = spark.createDataFrame([(1, "f", "t", "a", f"one {nb} two"), (2, "g", "t", "a", "one of the two")], "file_id long, filename string, title string, author string, content string")
    idx = TextIndex.build(files, 60)
    for text, mode, found in [(nb, "phrase", [1]), (nb, "logical", [1]), ("of the", "phrase", [2]), (f"one <1> {nb}", "logical", [1])]:
        assert [r.file_id for r in search_files(idx, text, mode).collect()] == found


def test_spans_of_or_in_a_distance_come_once(spark):
    from quire.operators.query import compile_query
    from quire.plans.search import match

    files = spark.createDataFrame([(1, "f", "t", "a", "a b c a b")], "file_id long, filename string, title string, author string, content string")
    idx = TextIndex.build(files, 60)
    for text in ["(a | a) <1> b", "((a & b) | a) <1> b", "((a | a) & b) <1> b"]:
        spans, _ = match(idx, compile_query(spark, text, "logical"))
        assert sorted((r.s, r.e) for r in spans.collect()) == [(1, 2), (4, 5)]


def test_single_book_reads_one_bucket(spark, tmpdir_path):
    from quire.sources.corpus import corpus_files

    tables = TextIndex.build(corpus_files(spark, "/root/testdata/sf0.001"), 60).write_tables(
        "onebook_t", buckets=8, path=tmpdir_path + "/t"
    )
    df = file_matches(tables, "of <-> the", "logical", 7)
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "SelectedBucketsCount: 1 out of 8" in plan
    want = sorted(r.term for r in file_matches(TextIndex.build(corpus_files(spark, "/root/testdata/sf0.001"), 60), "of <-> the", "logical", 7).collect())
    assert sorted(r.term for r in df.collect()) == want
