import random

import numpy as np
import pytest

from quire.llm.components import components
from quire.llm.near_dedup import banding, link_forest, near_groups, shingle_sets, sketches
from quire.llm.textblocks import blocks
from tests.llm import helpers as H


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 160))]
        texts += variants(rng, base, 40 if g == 0 else rng.randint(1, 6), 12)
    texts += [texts[3]] * 9  # exact copies
    texts += ["", "   \n", "one", "ONE", "two words", "two  words\n", "É x y z", "é x y z"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rows = corpus(k)
    got = {r.doc_id: r for r in near_groups(H.documents(spark, rows), k, percent).collect()}
    want = H.near_groups(rows, k, percent)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert all(got[d].n_shingles == len(H.shingles(t, k)) for d, t in rows)


def test_nulls_repeats_and_empty(spark):
    long = " ".join(f"v{i}" for i in range(50_000))
    rows = [(None, "a b c d"), (None, None), (5, None), (4, "a b c d"), (9, "a b c d"), (9, "q r s t"), (9, "q r s t"), (11, "q r s t"), (12, long), (13, long + " end")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_groups(H.documents(spark, rows), 3, 85).collect()), key=str)
    want = [(None, 2, None, True), (None, 0, None, True), (5, 0, 5, True), (4, 2, 4, True), *[(9, 2, 4, False)] * 3, (11, 2, 4, False), (12, 49998, 12, True), (13, 49999, 12, False)]
    assert got == sorted(want, key=str)
    assert near_groups(H.documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links + [(None, 3)], "u long, v long")).collect()}
    parent = {i: i for e in links for i in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_every_coordinate_fills_and_estimates():
    texts = ["one", " ".join(f"a{i}" for i in range(3000))]
    base = [f"b{i}" for i in range(400)]
    texts += [" ".join(base), " ".join(base[:360] + [f"c{i}" for i in range(40)])]
    import pyarrow as pa

    (block,) = blocks(pa.array(texts))
    value, bounds = shingle_sets(block, 1)
    s = sketches(value, bounds)
    assert (s < np.iinfo(np.uint64).max).all()
    assert abs((s[2] == s[3]).mean() - 360 / 440) < 0.1
    assert banding(85) == (7, 30) and banding(80) == (5, 29)


def test_forest_links_all_that_is_linked():
    sets = [np.array(sorted(x), np.uint64) for x in ({1, 2, 3, 4}, {1, 2, 3, 4, 5}, {1, 2, 3, 5, 4}, {9}, {9, 10})]
    links = link_forest(np.arange(5), sets, None, 80)
    assert len(links) == 2 and {0, 1, 2} == {i for e in links for i in e}


def test_low_percents_keep_the_promised_miss():
    for percent in range(6, 101):
        rows, bands = banding(percent)
        assert rows * bands <= 224 and (1 - (percent / 100) ** rows) ** bands <= 1e-5
    for percent in (0, 1, 5):
        try:
            banding(percent)
        except ValueError:
            continue
        raise AssertionError(percent)
