"""Exact integer k-means against a plain pass."""

import hashlib
import math

import numpy as np
import pytest

from plenum.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string, of int"


def plain(rows, k, rounds, width):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [r[1] for r in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((square(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups, centroids)]
    return sorted((i if i is not None else -1, near(v)[1], near(v)[0] if near(v)[0] < 1 << 63 else None, ",".join(map(str, centroids[near(v)[1]]))) for i, v in kept)


def found(spark, rows, k, rounds, width, **parameters):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    got = clustering.cluster(df, k=k, rounds=rounds, width=width, **parameters)
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.centroid) for r in got.collect())


def test_equals_a_plain_pass_on_ties_nulls_repeats_and_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in range(200)]  # many ties
    rows += [(400, [0.5] * 6)] * 7 + [(None, [0.1] * 6), (600, None), (601, [1.0] * 5), (602, [1.0] * 5 + [None]), (603, [float("nan")] * 6), (604, [float("inf")] * 6), (605, [])]
    assert found(spark, rows, 12, 4, 6) == plain(rows, 12, 4, 6)
    assert found(spark, rows, 12, 4, 6, pivots=3) == plain(rows, 12, 4, 6)
    huge = rows[:80] + [(900 + i, [(-1.0) ** i * 1e18 * (i + 1), 3e30, -1e200, 0.0, 1.0, 2.0]) for i in range(5)]
    assert found(spark, huge, 9, 3, 6) == plain(huge, 9, 3, 6)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.25, -0.5]) for i in range(5)]
    assert found(spark, same, 3, 2, 2) == plain(same, 3, 2, 2)
    few = [(1, [0.0, 1.0]), (2, [1.0, 0.0])]
    assert found(spark, few, 40, 5, 2) == plain(few, 40, 5, 2)
    assert found(spark, [], 3, 2, 2) == [] and found(spark, [(1, None)], 3, 2, 2) == []


def test_inertia_and_null_distances(spark):
    df = spark.createDataFrame([(1, 0, 3, "a"), (2, 0, 4, "a"), (3, 1, 5, "b"), (4, 2, None, "c")], "vec_id long, cluster int, distance long, centroid string")
    got = {r.vec_id: (r.cluster_inertia, r.inertia) for r in clustering.with_inertia(df).collect()}
    assert got == {1: (7, None), 2: (7, None), 3: (5, None), 4: (None, None)}


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_bounds_leave_out_centroids_but_never_the_nearest(spread):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 64))
    x = clustering.whole_numbers(middles[rng.integers(0, 40, 3000)] + spread * rng.normal(size=(3000, 64)), 256)
    centroids = clustering.whole_numbers(middles, 256)
    simplex = clustering.Simplex([[int(v) for v in c] for c in centroids], 16)
    at, least, done = clustering.nearest(x, simplex.apex(x), centroids, simplex.apex(centroids))
    exact = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (at == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
    assert done < len(x) * (1.5 if spread < 0.1 else 40)


def test_apexes_keep_distances_within_their_bounds():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(200, 20)) * 100
    simplex = clustering.Simplex([list(p) for p in points[:12]] + [list(points[0])], 10)
    a = simplex.apex(points)
    for i, j in rng.integers(0, 200, (500, 2)):
        true, base = ((points[i] - points[j]) ** 2).sum(), ((a[i, :-1] - a[j, :-1]) ** 2).sum()
        assert base + (a[i, -1] - a[j, -1]) ** 2 <= true + 1e-6 and true <= base + (a[i, -1] + a[j, -1]) ** 2 + 1e-6
