"""Centroid clustering: against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import pytest

from quire.llm.centroids import centroid_clusters

SCHEMA = "vec_id long, embedding array<float>, cluster int, q string"


def brute(rows, k, rounds, dim, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [q for _, q in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min(range(len(c)), key=lambda j: (far(q, c[j]), j))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, q in kept:
            own[near(q)].append(q)
        c = [[sum(x) // len(qs) for x in zip(*qs)] if qs else c[j] for j, qs in enumerate(own)]
    found = [(i, near(q), far(q, c[near(q)])) for i, q in kept]
    by = {j: sum(d for _, g, d in found if g == j) for j in range(len(c))}
    return sorted(((i, g, d, by[g], sum(by.values()), hashlib.sha256(",".join(map(str, c[g])).encode()).hexdigest()) for i, g, d in found), key=str)


def rows_of(spark, rows, **more):
    full = [(i, e, 5, "x") for i, e in rows]
    return sorted((tuple(r) for r in centroid_clusters(spark.createDataFrame(full, SCHEMA), **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    point = lambda: [rng.choice([0.0, -0.5, 0.25, 0.5]) + rng.choice([0, 0, 0.125, -0.0004]) for _ in range(4)]
    rows = [(i, point()) for i in range(150)]
    rows += [(7, rows[7][1]), (7, [0.5] * 4), (None, [0.25] * 4), (200, None), (201, []), (202, [0.1] * 3), (203, [0.1, None, 0.1, 0.1])]
    rows += [(204, [0.1, float("nan"), 0.1, 0.1]), (205, [0.1, float("-inf"), 0.1, 0.1])]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(80)]  # a hot group of copies
    for k, rounds in ((5, 10), (3, 1), (8, 0)):
        assert rows_of(spark, rows, clusters=k, rounds=rounds, dim=4) == brute(rows, k, rounds, 4)


def test_few_rows_and_empty_clusters(spark):
    same = [(i, [0.5, -0.25]) for i in range(6)]
    got = rows_of(spark, same, clusters=4, dim=2)
    assert got == brute(same, 4, 10, 2) and {r[1] for r in got} == {0}
    assert rows_of(spark, same[:2], clusters=4, dim=2) == brute(same[:2], 4, 10, 2)
    assert rows_of(spark, [], dim=2) == [] and rows_of(spark, [(1, None)], dim=2) == []


def test_floor_goes_down(spark):
    rows = [(1, [-0.0001]), (2, [-0.0030]), (3, [0.0001]), (4, [-5.0])]
    assert rows_of(spark, rows, clusters=2, dim=1) == brute(rows, 2, 10, 1)


def test_large_components_are_refused(spark):
    assert rows_of(spark, [(1, [131072.0]), (2, [-131072.0])], clusters=1, dim=1) == brute([(1, [131072.0]), (2, [-131072.0])], 1, 10, 1)
    with pytest.raises(Exception, match="would not fit"):
        rows_of(spark, [(1, [140000.0])], dim=1)
