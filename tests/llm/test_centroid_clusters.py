"""Centroid clustering with pivots, held against plain Python integers."""

import hashlib
import math
import random

import numpy as np

from loggraph.llm import centroid_clusters as C


def plain(rows, k, rounds, dim, scale=64):
    """rows: (vec_id, vector) -> sorted (vec_id, cluster, distance), centroids."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(x * scale) for x in v]) for i, v in kept]
    sha = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    first = sorted(zip(ints, kept), key=lambda p: (sha(p[0][0]), p[1][1]))
    cs = [v for (_, v), _ in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in ints:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(cs)]
    return sorted((i is None, i or 0, near(v)[1], near(v)[0]) for i, v in ints), cs


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, d string")
    found, cs = C.cluster(df, **options)
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect()), cs


def test_equals_plain_rounds(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(400)]
    rows += [(3, rows[3][1])] * 200 + [(None, rows[7][1]), (900, None), (901, [1.0] * 5), (902, [1.0] * 5 + [float("nan")]),
                                      (903, [None] + [1.0] * 5), (904, [float("inf")] * 6)]
    assert run(spark, rows, k=7, dim=6) == plain(rows, 7, 3, 6)
    assert run(spark, rows, k=7, dim=6, n_pivots=1, rounds=1) == plain(rows, 7, 1, 6)


def test_ties_few_vectors_and_none(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 0, 2, 2, 1, 1])]
    assert run(spark, rows, k=4, dim=2) == plain(rows, 4, 3, 2)
    assert run(spark, rows[:2], k=16, dim=2) == plain(rows[:2], 16, 3, 2)
    found, cs = C.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"))
    assert found.count() == 0 and cs == [] and C.with_inertia(found, cs).count() == 0


def test_components_beyond_64_bits(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1, 1]) * 10 ** r.uniform(0, 7) for _ in range(4)]) for i in range(120)]
    assert run(spark, rows, k=5, dim=4) == plain(rows, 5, 3, 4)
    huge = [(0, [1e30, 0.0]), (1, [-1e30, 5.0]), (2, [0.5, 0.25]), (3, [1e308, -1e308])]
    got, cs = run(spark, huge, k=2, dim=2)
    want, plain_cs = plain([(i, [x if abs(x) < 1e300 else int(x) for x in v]) for i, v in huge], 2, 3, 2)
    assert cs == plain_cs
    assert got == [(a, i, c, d if d < C.LONG else None) for a, i, c, d in want]


def test_no_centroid_is_lost_by_the_bound():
    r = np.random.default_rng(5)
    rows, centroids, pivots = (r.integers(-40, 40, (n, 8)) for n in (500, 9, 4))
    d = np.stack([C.roots(C.squared(rows, p)) for p in pivots], axis=1)
    near, best = C.assign(rows, d, centroids, pivots)
    exact = ((rows[:, None, :] - centroids) ** 2).sum(axis=2)
    assert near.tolist() == exact.argmin(axis=1).tolist() and best.tolist() == exact.min(axis=1).tolist()


def test_limbs():
    for n in (0, 1, -1, 2 ** 40, -2 ** 40, 10 ** 40, -10 ** 40, 2 ** 80 - 1):
        assert sum(x << (C.LIMB * i) for i, x in enumerate(C.limbs(n))) == n
        assert all(abs(x) <= 1 << C.LIMB for x in C.limbs(n))
