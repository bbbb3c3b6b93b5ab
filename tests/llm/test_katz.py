import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import katz
from quire.llm.katz import katz_scores, model_discounts
from tests.llm import helpers as H

END = "</end>"


def brute(rows, order):
    """A dictionary version of the model."""
    docs = [(d, H.words(H.lower_ascii(t or "")) + [END]) for d, t in rows]
    train = [w for d, w in docs if H.crc_fold(d, 7) != 2]
    counts = [None] + [Counter() for _ in range(order)]
    for w in train:
        for i in range(len(w)):
            for n in range(1, order + 1):
                context = tuple(w[j] if j >= 0 else "<s>" for j in range(i - n + 1, i))
                counts[n][context + (w[i],)] += 1
    d = {}
    for n in range(1, order + 1):
        n_r = np.zeros(katz.K + 2, np.int64)
        for c in counts[n].values():
            if c <= katz.K + 1:
                n_r[c] += 1
        d[n] = model_discounts(n_r)
    disc = lambda n, c: c * (d[n][c] if c < len(d[n]) else 1.0)
    total = sum(counts[1].values())
    mass = sum(disc(1, c) for c in counts[1].values())
    below = total + 1 if total - mass <= 1e-9 * max(total, 1) else total
    by_context = [None, None] + [defaultdict(dict) for _ in range(order - 1)]
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            by_context[n][g[:-1]][g[-1]] = c

    def p(n, context, w):
        if n == 1:
            if not total:
                return 1.0
            c = counts[1][(w,)]
            return disc(1, c) / below if c else 1 - mass / below
        seen = by_context[n].get(context)
        if not seen:
            return p(n - 1, context[1:], w)
        t, m = sum(seen.values()), sum(disc(n, c) for c in seen.values())
        t = t + 1 if t - m <= 1e-9 * t else t
        if w in seen:
            return disc(n, seen[w]) / t
        return (1 - m / t) / (1 - sum(p(n - 1, context[1:], x) for x in seen)) * p(n - 1, context[1:], w)

    v = len(counts[1])
    out = {}
    for doc, w in docs:
        score = sum(math.log10(p(order, tuple(w[j] if j >= 0 else "<s>" for j in range(i - order + 1, i)), w[i])) for i in range(len(w)))
        base = sum(math.log10((counts[1][(x,)] + 1) / (total + v + 1)) for x in w)
        out[doc] = (H.crc_fold(doc, 7) == 2, len(w), sum(counts[1][(x,)] > 0 for x in w), total, base, score)
    if total and order > 1:  # every context's probabilities add up to one
        vocab = [g[0] for g in counts[1]]
        for context in list(by_context[order])[:15]:
            assert abs(sum(p(order, context, w) for w in vocab) + p(order, context, object()) - 1) < 1e-9
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "W1\tw2\n\nw3 never-seen word"), (503, "x " * 30_000)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_BYTES", 2000)
    rows = corpus(order)
    got = {r.doc_id: tuple(r)[1:] for r in katz_scores(H.documents(spark, rows), order=order).collect()}
    want = brute(rows, order)
    assert got.keys() == want.keys()
    for doc, w in want.items():
        assert got[doc][:4] == w[:4]
        assert got[doc][4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_nulls_repeats_and_no_training(spark):
    got = katz_scores(H.documents(spark, [(None, "a b"), (3, "a b"), (3, "a b"), (None, None)])).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens) for r in got), key=str) == [(3, False, 3), (3, False, 3), (None, False, 1), (None, False, 3)]
    assert katz_scores(H.documents(spark, [])).count() == 0
    held = next(i for i in range(100) if H.crc_fold(i, 7) == 2)
    (r,) = katz_scores(H.documents(spark, [(held, "a b")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_discounts():
    assert model_discounts(np.array([0, 1000, 400, 200, 120, 80, 60])).tolist() != [1.0, 0.5]
    assert model_discounts(np.zeros(7)).tolist() == [1.0, 0.5]


def test_corpus_counts_beyond_32_bits(spark):
    """Two chunks of 3 * 10**9 copies of one word each: the count that goes back is their sum."""
    keys, each = np.array([7, 9], np.uint64), np.array([3_000_000_000, 1], np.uint32)
    rows = [(chunk, 1, 0, katz.pack_keys(keys), katz.pack(each)) for chunk in (0, 1)]
    answers = katz.answer_counts(spark.createDataFrame(rows, katz.ROW_SQL))
    tokens = katz.pack(np.array([0, 1], np.int32), keys), katz.pack(np.zeros(1, np.int64), np.zeros(1, np.uint8), np.ones(1, np.uint8), np.array([0, 2]))
    for chunk in (0, 1):
        back = [r for r in answers.collect() if r.chunk == chunk]
        table = pa.table({"kind": [katz.CODES, 1], "a": [tokens[0], back[0].a], "b": [tokens[1], back[0].b]}, schema=pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]))
        c = katz.Chunk(table, 1)
        stats = katz.read_stats(answers)
        assert stats.n == 6_000_000_002
        got = c.probabilities(1, stats)
        assert abs(got[0] - 6e9 / stats.n) < 1e-6


def test_registered_order_is_three(spark, tmp_path):
    """Only the word two places back tells 'x m p' from 'y m q': the query's scores are the trigram model's."""
    from quire.llm.queries import op8_katz_scores

    rows = [(i, "x m p" if i % 2 else "y m q") for i in range(60)]
    H.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op8_katz_scores(spark, str(tmp_path)).collect()}
    want, two = brute(rows, 3), brute(rows, 2)
    assert all(got[d] == pytest.approx(want[d]) for d in got) and got[0][-1] != pytest.approx(two[0][-1])
