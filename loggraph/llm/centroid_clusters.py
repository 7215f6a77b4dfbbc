"""Operator 13: centroid clustering with a LAESA pivot table.

Vectors become integers (``floor(scale * x)``). A few fixed pivots are chosen among the
first vectors in hash order, each the farthest from those before it; the distance of
every vector to every pivot is computed once and stored beside the vector. In each round
the centroids' own pivot distances bound every vector's distance to them from below
(``max |d(x, p) - d(c, p)|``, triangle inequality): the centroid with the smallest bound
is measured exactly, centroids whose bound lies above that distance are out, and the
others receive exact integer distances.

A round reads the stored table, adds up its vectors per cluster inside each task and
shuffles only those sums (clusters x components rows a task, summed before the shuffle),
so a cluster that holds most vectors is no hot key. Centroids (``k`` x components
integers) are the only thing that passes the driver.

Integers are exact at any size: 64-bit arithmetic where every component lies within
``NARROW``, Python integers for the rare vectors beyond; sums are kept in limbs.

Defined cases: vectors that are null, of another length, or with null or non-finite
components are left out; of equal distances the smaller centroid number wins; an empty
cluster keeps its centroid; with fewer vectors than ``k`` each is a centroid; repeated
rows count each; rows without id stay and come last in hash order; of equal hashes the
smaller vector comes first; a distance or sum that no 64-bit integer holds is null; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_search import usable
from .common import materialize, read_table

#: |component| up to which squared distances of up to 256 components fit 64 bits.
NARROW = 1 << 26
#: Rows of one numpy tile.
TILE = 4096
LIMB = 40
LONG = 1 << 63
#: Relative room for the rounding of square roots and their differences.
SLACK = 1e-9


def integers(rows: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles, as 64-bit integers where they are narrow, else as
    Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(rows * float(scale))
    if not rows.size or np.abs(scaled).max() <= NARROW:
        return scaled.astype(np.int64)
    exact = [[math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in row] for row in rows.tolist()]
    return np.array(exact, dtype=object)


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows to one point."""
    gap = rows - point
    return (gap * gap).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots within a relative 1e-15, at most 1e308."""
    if squares.dtype == object:
        return np.array([math.sqrt(x) if x < 10 ** 300 else min(float(math.isqrt(min(x, 10 ** 616))), 1e308) for x in map(int, squares)])
    return np.sqrt(squares.astype(np.float64))


def stack(points: list[list[int]]) -> np.ndarray:
    narrow = all(abs(x) <= NARROW for p in points for x in p)
    return np.array(points, dtype=np.int64 if narrow else object)


def assign(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and exact squared distance of each row."""
    n, k = len(rows), len(centroids)
    if rows.dtype == object or centroids.dtype == object:
        rows, centroids = rows.astype(object), centroids.astype(object)
    between = np.stack([roots(squared(pivots, c)) for c in centroids])  # centroid x pivot
    low = np.zeros((n, k))
    for p in range(len(pivots)):
        room = SLACK * to_pivots[:, p, None] + SLACK * between[:, p]
        np.maximum(low, np.abs(to_pivots[:, p, None] - between[:, p]) - room, out=low)
    first = low.argmin(axis=1)
    best = np.empty(n, dtype=rows.dtype)
    for c in np.unique(first).tolist():
        mine = first == c
        best[mine] = squared(rows[mine], centroids[c])
    near, reach = first.copy(), roots(best) * (1 + SLACK)
    for c in range(k):
        mine = np.flatnonzero((first != c) & (low[:, c] <= reach))
        d = squared(rows[mine], centroids[c])
        closer = (d < best[mine]) | ((d == best[mine]) & (c < near[mine]))
        mine, d = mine[closer], d[closer]
        best[mine], near[mine] = d, c
        reach[mine] = roots(d) * (1 + SLACK)
    return near, best


def limbs(n: int) -> list[int]:
    """``n`` as limbs of LIMB bits, the last one signed."""
    out = []
    while not -(1 << LIMB) < n < 1 << LIMB:
        out.append(n & ((1 << LIMB) - 1))
        n >>= LIMB
    return [*out, n]


def pivot_table(vectors: DataFrame, pivots: list[list[float]], scale: int, dim: int) -> DataFrame:
    """(vec_id, v, d): each vector as doubles beside its distances to the pivots."""
    def measure(batches):
        points = integers(np.array(pivots, dtype=np.float64).reshape(len(pivots), dim), scale)
        for b in batches:
            for at in range(0, b.num_rows, TILE):
                part = b.slice(at, TILE)
                rows = integers(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                d = np.stack([roots(squared(rows, p)) for p in points], axis=1)
                held = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), len(points))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), held.cast(pa.list_(pa.float64()))],
                                                 ["vec_id", "v", "d"])

    return materialize(vectors.mapInArrow(measure, "vec_id long, v array<double>, d array<double>"), "pivot_table")


def _tiles(batches, dim: int, scale: int):
    """(ids, integer rows, pivot distances) of the stored table; wide vectors apart."""
    for b in batches:
        for at in range(0, b.num_rows, TILE):
            part = b.slice(at, TILE)
            v, d = (part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for i in (1, 2))
            wide = np.abs(v).max(axis=1) * scale > NARROW - 1
            for some in (~wide, wide):
                if some.any():
                    yield part.column(0).filter(pa.array(some)), integers(v[some], scale), d[some]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1",
            n_pivots: int = 8, pivot_pool: int = 64, id_col: str = "vec_id",
            vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector, and the final centroids."""
    v = F.col(vector_col).cast("array<double>")
    rows = (vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) == dim))
            .select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    pool = [r["v"] for r in rows.orderBy(order.asc_nulls_last(), "v").limit(max(k, pivot_pool)).collect()]
    spark = vectors.sparkSession
    if not pool:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    exact = integers(np.array(pool), scale)
    centroids = [[int(x) for x in row] for row in exact[:k]]
    # pivots: each the farthest of the pool from those before it
    chosen, far = [0], roots(squared(exact, exact[0]))
    while len(chosen) < min(n_pivots, len(pool)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, roots(squared(exact, exact[chosen[-1]])))
    points = [pool[i] for i in chosen]
    table = pivot_table(rows, points, scale, dim)

    def nearest(batches, now):
        pivots, held = integers(np.array(points), scale), stack(now)
        for ids, ints, d in _tiles(batches, dim, scale):
            yield ids, ints, *assign(ints, d, held, pivots)

    def sums(now):
        def run(batches):
            count, total = [0] * len(now), [[0] * dim for _ in now]
            for _, ints, near, _ in nearest(batches, now):
                for c in np.unique(near).tolist():
                    mine = near == c
                    count[c] += int(mine.sum())
                    total[c] = [a + int(b) for a, b in zip(total[c], ints[mine].sum(axis=0).tolist())]
            out = [(c, -1, 0, n) for c, n in enumerate(count) if n]
            out += [(c, j, i, x) for c, n in enumerate(count) if n for j, t in enumerate(total[c]) for i, x in enumerate(limbs(t))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)], ["c", "j", "i", "x"])

        return table.mapInArrow(run, "c long, j long, i long, x long").groupBy("c", "j", "i").agg(F.sum("x").alias("x"))

    for _ in range(rounds):
        found: dict[tuple[int, int], int] = {}
        for c, j, i, x in sums(centroids).collect():  # at most k x (dim x limbs + 1) rows
            found[c, j] = found.get((c, j), 0) + (x << (LIMB * i))
        centroids = [[found[c, j] // found[c, -1] for j in range(dim)] if (c, -1) in found else old
                     for c, old in enumerate(centroids)]

    def final(batches):
        for ids, _, near, best in nearest(batches, centroids):
            d = pa.array([int(x) if x < LONG else None for x in best.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), d], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(final, "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add cluster_inertia, inertia and centroid_sha256 by one small table of clusters."""
    assigned = materialize(assigned, "assigned")
    sums = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}  # k rows
    total = sum(sums.values()) if None not in sums.values() else None
    per = [(c, d, total if total is not None and total < LONG else None,
            hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in sorted(sums.items())]
    named = assigned.sparkSession.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(named), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(read_table(spark, sf_dir, "embeddings")))


def _round_sql(name: str, before: str) -> str:
    """One round: every vector's nearest centroid of ``before``, then the new centroids."""
    return f"""
{name}_near AS (
  SELECT v.rid, arg_min(c.c, (c.d, c.c)) AS c FROM v, LATERAL (
    SELECT b.c, list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM {before} b) c GROUP BY v.rid),
{name}_sum AS (
  SELECT c, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (
    SELECT n.c, unnest(range(1, 65)) AS j, unnest(v.x) AS x FROM {name}_near n JOIN v USING (rid)) GROUP BY c, j),
{name} AS (
  SELECT b.c, coalesce(s.x, b.x) AS x FROM {before} b
  LEFT JOIN (SELECT c, list(x ORDER BY j) AS x FROM {name}_sum GROUP BY c) s USING (c))"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x, embedding
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, embedding) - 1 AS c, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, embedding) <= 16),
{",".join(_round_sql(f"c{r}", f"c{r - 1}").replace(" AS (", " AS MATERIALIZED (") for r in (1, 2, 3))},
a AS (
  SELECT v.rid, any_value(v.vec_id) AS vec_id, arg_min(c.c, (c.d, c.c)) AS c, min(c.d) AS d FROM v, LATERAL (
    SELECT b.c, list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM c3 b) c GROUP BY v.rid)
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a JOIN c3 ON a.c = c3.c
"""
