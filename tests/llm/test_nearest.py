"""Operator 3 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from loggraph.llm.ann_search import lengths, nearest, quantised


def brute(rows, k):
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in rows
            if i is not None and v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in rows:
        if q % 3 == 0:
            s = sorted((-float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), i) for i, y in rows if i != q and len(y) == len(x))
            out.setdefault(q, []).append([(i, -c) for c, i in s[:k]])
    return out


def compare(spark, rows, k=5, **sizes):
    df = spark.createDataFrame([(i, v, "x", 0.0) for i, v in rows], "vec_id long, embedding array<double>, rank string, score double").repartition(4)
    got = {}
    for r in nearest(df, F.col("vec_id") % 3 == 0, k, **sizes).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: f[0] for q, f in brute(rows, k).items() if f[0]}
    assert got.keys() == want.keys()
    for q, found in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(found) + 1))
        assert np.allclose([m[2] for m in mine], [f[1] for f in found], atol=1e-12)
        assert [m[1] for m in mine] == [f[0] for f in found]


def test_quantisation_error_bound():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 24)), rng.normal(size=(60, 24))
    (a, s, e), (b, t, f) = quantised(x), quantised(y)
    near = (a.astype(float) @ b.astype(float).T) * s[:, None] * t
    true = (x / lengths(x)[:, None]) @ (y / lengths(y)[:, None]).T
    bound = lengths(a * s[:, None])[:, None] * f + e[:, None]
    assert (np.abs(near - true) <= bound + 1e-12).all()


def test_random_vectors_over_many_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    compare(spark, rows)
    compare(spark, rows, k=3, cell_candidates=60, cell_queries=40)


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0, 3.0]) for i in range(30)]
    odd = [(30, None), (33, [0.0, 0.0, 0.0]), (36, [1.0, None, 2.0]), (39, [nan, 1.0, 1.0]), (42, [inf, 1.0, 1.0]),
           (None, [1.0, 1.0, 1.0]), (45, []), (48, [1.0, 2.0]), (49, [2.0, 1.0]), (51, [1e-200, 2e-200, 0.0]), (52, [1e200, 0.0, 0.0])]
    compare(spark, same + [o for o in odd if o[0] not in (51, 52)])
    compare(spark, [(0, [1.0, 0.5]), (1, [1.0, 0.4]), (2, [-1.0, 0.5])])
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in nearest(df, F.col("vec_id") % 3 == 0).collect()}
    assert abs(got[51, 52] - 1 / np.sqrt(5)) < 1e-12


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 3 == 0).count() == 0


def test_repeated_query_rows_are_queries_of_their_own(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)]
    rows += [(0, rng.normal(size=8).tolist()), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest(df, F.col("vec_id") % 3 == 0, 5, cell_candidates=16, cell_queries=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    for q, found in brute(rows, 5).items():
        want = sorted((n + 1, i, round(s, 9)) for f in found for n, (i, s) in enumerate(f))
        assert sorted(got[q]) == want
    assert len(got[0]) == len(got[3]) == 10
