import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm.boosting import train
from quire.llm.quality_attention import Model, passages, quality_scores
from quire.llm.quality_rules import MONOTONE, base_failed, fit, judge, kept_documents, statistics
from quire.llm.shared import fold
from quire.llm.textblocks import blocks
from tests.llm import helpers as H

SF = "/root/testdata/sf0.01"


def brute(text):
    """The five base counts, by their definitions."""
    text = text or ""
    w = H.words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if H.words(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    marked = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


def odd_texts(seed=4):
    rng = random.Random(seed)
    bits = ["a", "b", "the", "Ünï", "🙂", "\n", "\n", " ", "\t", "#", "<>", "one two three four five six seven eight nine ", "x\x0b", "|", "\r\n"]
    return [None, "", " \n ", "a " * 9, "z\n" * 5, "l1\nl1 \nl1\n\nl1"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)]


@pytest.mark.parametrize("limit", [40, 1 << 20])
def test_counts_equal_brute_force(limit):
    texts = odd_texts()
    for block in blocks(pa.array(texts), limit):
        base, x = statistics(block)
        assert base.tolist() == [brute(t) for t in texts[block.first : block.first + block.n]]
        assert np.isfinite(x).all()


def test_rules_keep_good_and_reject_bad(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = fit(docs, labels, where=fold(F.col("doc_id"), 3) != 1)
    rows = judge(docs, forest).join(labels, "doc_id").filter(fold(F.col("doc_id"), 3) == 1).collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.1
    assert all(r.base_failed == bool(base_failed(np.array([[r.n_words, 0, 0, 0, r.n_repeat_words]]))[0]) for r in rows)
    kept = {r.doc_id for r in judge(docs, forest).filter("kept").collect()}
    left = kept_documents(docs, forest)
    assert left.columns == docs.columns and {r.doc_id for r in left.select("doc_id").collect()} == kept


def test_monotone_features_never_raise_the_score():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(MONOTONE)))
    y = (x[:, 0] + rng.random(600) > x[:, 2] + 0.5 * np.sin(9 * x[:, 3])).astype(float)
    forest = train(x, y, MONOTONE)
    for f in np.flatnonzero(MONOTONE):
        at = np.repeat(x[:50], 21, axis=0)
        at[:, f] = np.tile(np.linspace(-0.2, 1.2, 21), 50)
        assert (np.diff(forest.score(at).reshape(50, 21), axis=1) * MONOTONE[f] >= -1e-12).all()
    assert np.mean((forest.probability(x) > 0.5) == y) > 0.8


def no_labels(spark):
    return spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")


def test_odd_rows_and_no_labels(spark):
    rows = [(None, None), (1, ""), (1, "word " * 50), (2, "x" * 300_000), (3, " ".join(f"w{i}" for i in range(60_000)))]
    d = H.documents(spark, rows)
    got = judge(d, fit(d, no_labels(spark))).collect()
    assert len(got) == 5 and {(r.doc_id, r.n_words, r.kept) for r in got} == {(None, 0, False), (1, 0, False), (1, 50, False), (2, 1, False), (3, 60_000, True)}
    scores = quality_scores(d, no_labels(spark)).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scores)
    empty = H.documents(spark, [])
    assert judge(empty, fit(empty, no_labels(spark))).count() == 0 and quality_scores(empty, no_labels(spark)).count() == 0


def test_attention_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows} == {True, False} and all(r.held_out == (H.crc_fold(r.doc_id, 3) == 1) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_attention_gradient_and_bags():
    rng = np.random.default_rng(0)
    x, starts, y = rng.random((9, 5)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    model = Model(np.zeros(5), np.ones(5))

    def loss():
        p = model.score(x, starts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = model.gradient(x, starts, y)
    for k, v in model.p.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        down = loss()
        v[at] = old
        assert grad[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)
    long = " ".join("w" for _ in range(100_000))
    (block,) = blocks(pa.array(["", long, "a b", None]))
    x, bounds = passages(block)
    assert np.diff(bounds).tolist() == [1, 256, 1, 1] and not x[0, :-1].any() and x[1:257, :20].sum(axis=1).min() > 0


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (300, 4)).astype(float)  # ties with the thresholds
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 1, 300) > 0).astype(float)
    forest = train(x, y, np.array([1, -1, 0, 0]), trees=12, depth=3)
    assert np.isinf(forest.threshold).any() and np.isfinite(forest.threshold).any()
    odd = np.array([[np.inf, 0, 0, 0], [-np.inf, 9, 9, 9], [0, 0, 0, 0]], float)
    rows = np.concatenate([x, odd])
    want = []
    for row in rows.tolist():
        total = forest.prior
        for feature, threshold, leaf in zip(forest.feature.tolist(), forest.threshold.tolist(), forest.leaf.tolist()):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        want.append(total)
    assert forest.score(rows) == pytest.approx(want, abs=1e-12)
    assert forest.score(rows[:0]).shape == (0,)


def test_attention_equals_a_plain_forward_pass():
    rng = np.random.default_rng(6)
    x, starts = rng.normal(0, 2, (11, 5)), [0, 1, 7, 9]
    model = Model(rng.normal(0, 1, 5), rng.random(5) + 0.5)
    p = {k: v.tolist() for k, v in model.p.items()}
    product = lambda a, m: [sum(i * row[j] for i, row in zip(a, m)) for j in range(len(m[0]))]
    scores, weights = [], []
    for a, b in zip(starts, [*starts[1:], len(x)]):
        bag = []
        for row in x[a:b].tolist():
            unit = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
            h = [math.tanh(v + c) for v, c in zip(product(unit, p["W"]), p["b"])]
            gate = [math.tanh(v) / (1 + math.exp(-u)) for v, u in zip(product(h, p["V"]), product(h, p["U"]))]
            bag.append((math.exp(sum(g * w for g, w in zip(gate, p["w"]))), h))
        total = sum(e for e, _ in bag)
        weights += [e / total for e, _ in bag]
        z = [sum(e / total * h[j] for e, h in bag) for j in range(len(p["c"]))]
        scores.append(1 / (1 + math.exp(-sum(v * c for v, c in zip(z, p["c"])) - p["d"][0])))
    assert model.score(x, np.array(starts)) == pytest.approx(scores, abs=1e-12)
    assert model.forward(x, np.array(starts))[5] == pytest.approx(weights, abs=1e-12)
