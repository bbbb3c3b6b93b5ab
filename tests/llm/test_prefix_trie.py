"""Conversation prefix trie: against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.prefix_trie import neighbour_lcp, ordered_turns, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, depth long, ka string"


def ordered(rows):
    of = {}
    for c, turn, role, text in rows:
        if c is not None:
            of.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    mixed = lambda t: hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()
    return {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], mixed(t)))] for c, ts in of.items()}


def with_heads(of, group, heads):
    out = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = of.get(c - int(np.fmod(c, group)), [])[:h] + own[h:]
    return out


def brute(of):
    members = {}
    for c, seq in of.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    kids = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in members}
    out = []
    for p, ms in members.items():
        sub = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(ms), len(p), parent, len(ms), kids[p], sum(kids[q] == 0 for q in sub), saved, sha([c for c in ms if len(of[c]) == len(p)])))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA)


def trie(spark, rows, heads=True, **more):
    turns = ordered_turns(table(spark, rows))
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    turns, ids = rebuilt(turns) if heads else (turns, ids)
    return sorted((tuple(r) for r in prefix_trie(turns, ids, **more).collect()), key=str)


def some_rows(seed, convs=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 400), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "über " * 3])))
    return rows


@pytest.mark.parametrize("seed,more", [(1, {}), (3, {"segment": 3, "block_rows": 2}), (4, {"segment": 4, "block_turns": 5})])
def test_rebuilt_tries_equal_brute_force(spark, seed, more):
    rows = some_rows(seed)
    assert trie(spark, rows, **more) == brute(with_heads(ordered(rows), 100, 6))


@pytest.mark.parametrize("more", [{"block_rows": 2, "segment": 50}])
def test_hot_groups_and_odd_rows(spark, more):
    hot = [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(5)]  # copies
    one = [(7, t, "user", "turn " + str(t % 3)) for t in range(200)]  # a long conversation
    twin = [(8, t, "user", "turn " + str(t % 3)) for t in range(150)]
    odd = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 1, "user", "lost"), (2, 5, "ab", "c"), (3, 5, "a", "bc"), (4, None, "", "")]
    rows = hot + one + twin + odd
    got = trie(spark, rows, heads=False, **more)
    assert got == brute(ordered(rows))


def test_turnless_conversations_end_at_the_root(spark):
    none = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5][:4]
    rows = [(c, 0, "user", "x") for c in none] + [(500, 0, "user", "y")]
    got = trie(spark, rows)
    assert got == brute(with_heads(ordered(rows), 100, 6))
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 5 and root[7] == hashlib.sha256(",".join(map(str, none)).encode()).hexdigest()


def test_empty_table(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 0, "user", "x")]) == []


def test_neighbour_lcp():
    off = np.array([0, 2, 4, 4, 5])
    a = np.array([1, 2, 1, 3, 1])
    zero = np.zeros(4, np.int64)
    assert neighbour_lcp(zero, zero, off, a, a).tolist() == [1, 0, 0]
    assert neighbour_lcp(np.array([0, 1, 1, 2]), zero, off, a, a).tolist() == [-1, 0, -1]
