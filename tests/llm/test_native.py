"""Line dedup and mixing: against SQL on the driver's tables and brute force on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm.line_dedup import dedup_lines, extended, fingerprints, placed_lines, repeated_lines, seeds
from quire.llm.mixing import described, mixed, raked_cells, sampled_documents
from quire.llm.queries import ORACLE_SQL
from tests.llm import helpers as H
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    assert compare(spark, name, "/root/testdata/sf0.001", duck("/root/testdata/sf0.001")).get("values_match")


def brute_lines(rows, least):
    """Every line in a run of ``least`` words or more that stands earlier as well."""
    docs = {}
    for d, t in rows:
        docs.setdefault((d is not None, d or 0, t or "", t is None), t)
    order = sorted(docs, key=lambda k: k[:2])
    lines = {k: [(i, x, len(H.words(x))) for i, x in enumerate((docs[k] or "").split("\n")) if H.words(x)] for k in order}
    seen, gone = {}, {k: set() for k in order}
    for rank, k in enumerate(order):
        ls = lines[k]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                run = tuple(x for _, x, _ in ls[a:b])
                if sum(n for _, _, n in ls[a:b]) >= least:
                    first = seen.setdefault(run, (rank, a))
                    if first < (rank, a):
                        gone[k] |= {i for i, _, _ in ls[a:b]}
    return {k: "\n".join(x for i, x in enumerate(docs[k].split("\n")) if i not in gone[k]) for k in order if not k[3]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = ["a", "b c", "d e f", "g h i j", "", "  ", "k " * 6]
    rows = [(i, "\n".join(rng.choice(vocab) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, rows[5][1]), (7, rows[7][1])]
    got = {}
    for r in dedup_lines(H.documents(spark, rows), 8).collect():
        got.setdefault(r.doc_id, set()).add(r.text)
    for (has, d, _, _), text in brute_lines(rows, 8).items():
        assert text in got[d if has else None]
    assert got[100] == {None} and got[101] == {""}


def test_lines_empty_long_and_repeated(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(1, long), (2, "intro\n" + long), (3, "tail"), (3, "tail")]
    got = {(r.doc_id, r.removed_lines, r.text[:10]) for r in dedup_lines(H.documents(spark, rows)).collect()}
    assert got == {(1, 0, "line 0\nlin"), (2, 20_000, "intro"), (3, 0, "tail")}
    assert dedup_lines(H.documents(spark, [])).count() == 0


def test_only_shared_fingerprints_lead_to_windows(spark):
    words = [f"w{i} v{i}" for i in range(400)]
    rows = [(1, "\n".join(words)), (2, "\n".join(["own", *words[100:200], "end"])), (3, "\n".join(f"x{i} y{i}" for i in range(300)))]
    keyed = H.documents(spark, rows).select("doc_id", "text").withColumn("doc", F.col("doc_id"))
    placed = placed_lines(keyed, 20)
    prints = fingerprints(placed)
    chosen = {(r.doc, r.pos) for r in prints.collect()}
    assert len(chosen) < 802 / 2  # windows of 10 lines: about two of eleven are selected
    # each whole run of ten lines holds a chosen place, in the copy the same as in the original
    for doc, n in ((1, 400), (3, 300)):
        at = sorted(p for d, p in chosen if d == doc)
        assert all(any(k <= p < k + 10 for p in at) for k in range(n - 9))
    found = seeds(prints)
    got = {(r.doc, r.pos) for r in found.collect()}
    assert {d for d, _ in got} == {1, 2} and {p + 99 for d, p in got if d == 2} == {p for d, p in got if d == 1}
    # lines of the third text are not extended, and without seeds nothing is
    near = extended(placed, found, 20).collect()
    assert {r.doc for r in near} == {1, 2} and any(r.lines_a for r in near) and any(r.lines_b for r in near)
    assert extended(placed, found.limit(0), 20).count() == 0
    cut = {(r.doc, r.pos) for r in repeated_lines(keyed, 20).collect()}
    assert cut == {(2, k) for k in range(1, 101)}


def mix_rows(n=600):
    rng = random.Random(9)
    pick = lambda items, w: rng.choices(items, w)[0]
    return [(i, " ".join(rng.choice(["in", "is", "of", "zebra"]) for _ in range(rng.randint(1, 40))), pick(["en", "de", None], [8, 2, 1]), pick(["s0", "s1", "s2"], [8, 1, 1])) for i in range(n)]


def test_marginals_meet_their_targets(spark):
    d = described(H.documents(spark, mix_rows()))
    targets = {"source": {"s0": 0.4, "s1": 0.35, "s2": 0.25, "gone": 9.0}, "lang": {"en": 5, "de": 3, "": 2}}
    cells = raked_cells(d, targets, 12).collect()
    total = sum(targets["source"][s] for s in ("s0", "s1", "s2"))
    for s in ("s0", "s1", "s2"):
        assert sum(c.weight for c in cells if c.source == s) == pytest.approx(targets["source"][s] / total, abs=1e-4)
    for k, share in (("en", 0.5), ("de", 0.3), ("", 0.2)):
        assert sum(c.weight for c in cells if c.lang == k) == pytest.approx(share, abs=1e-4)
    assert max(c.probability for c in cells) == 1
    expected = sum(c.tokens * c.probability for c in cells if c.lang == "de") / sum(c.tokens * c.probability for c in cells)
    assert expected == pytest.approx(0.3, abs=1e-4)


def test_odd_rows_are_drawn_as_defined(spark):
    rows = mix_rows(50) + [(None, "in the zoo", None, None), (900, None, "en", "s0"), (901, " \n", "en", "s0"), (902, "of " * 50_000, "fr", "s9"), (3, "dup is", "en", "s0"), (3, "dup is", "en", "s0")]
    d = H.documents(spark, rows).withColumn("topic", F.lit("own")).withColumn("weight", F.lit(1))
    got = sampled_documents(d)
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == d.columns and not {900, 901} & set(ids) and ids.count(3) in (0, 2, 3, 1)
    assert sorted(ids, key=str) == sorted([r.doc_id for r in mixed(d).collect()], key=str)
    assert mixed(H.documents(spark, [])).count() == 0


def test_names_of_extra_columns_do_not_matter(spark):
    plain = H.documents(spark, mix_rows(60), extra=False)
    odd = plain
    for name in ("_words", "_tokens", "_p", "_n0", "_topic", "_doc", "probability"):
        odd = odd.withColumn(name, F.lit(7))
    got = sampled_documents(odd)
    assert got.columns == odd.columns and got.filter("_tokens <> 7 or _p <> 7 or _words <> 7").count() == 0
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(got) == ids(sampled_documents(plain)) == ids(mixed(odd))
