"""Operator 3: nearest neighbours by a block matrix join.

Vectors are packed into tiles: int8 codes of the unit vectors with one step width per
vector, the length of each vector's rounding error, and the original numbers. Every
query tile meets every candidate tile in one cell of a grid (a stated query set
against all rows, in blocks). In a cell the int8 product of two tiles gives all
cosines at once, each with a proven bound of its error: with unit vectors
``x = x' + e`` and ``y = y' + f``, ``x' y'`` is off by at most
``|x'| |f| + |e| |y|``. A pair whose upper bound is under the query's k-th best lower
bound so far is dropped; the pairs that survive are computed again from the original
numbers in double precision, and heaps of k entries merge tile after tile. A window
merges the cells' heaps, k rows of each.

The result is exact; a cell holds at most ``cell_candidates`` and ``cell_queries``
vectors (up to the spread of hashing tiles over the grid), so memory is bounded.

Defined cases: vectors that are null, zero or hold null or non-finite numbers take no
part, nor do rows without vec_id; only vectors of the same length are compared; a
query's own vec_id is no candidate for it; of equal cosines the smaller vec_id comes
first; repeated rows are candidates of their own, and a repeated query row is a query of
its own (its ranks come once per row); with fewer than k candidates all are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

TILE = 2048
TILES = "part int, dim int, ids binary, rows binary, codes binary, steps binary, errors binary, vectors binary"
FOUND = "query_row long, query_id long, vec_id long, score double"
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """No null and no non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return vector.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, step widths and lengths of the rounding errors of the rows' unit vectors."""
    unit = v / lengths(v)[:, None]
    steps = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / steps[:, None]).astype(np.int8)
    return codes, steps, np.sqrt(((unit - codes * steps[:, None]) ** 2).sum(axis=1))


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def safe(v: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles, scaled (cosines stay)."""
    top = np.abs(v).max(axis=1, initial=0)
    odd = (top > 1e100) | ((top < 1e-100) & (top > 0))
    if odd.any():
        v = v.copy()
        v[odd] /= top[odd, None]
    return v


def tiles(vectors: DataFrame, parts: int) -> DataFrame:
    """Tiles of (vec_id, v); ``part`` is the tile's place along its side of the grid."""
    narrow = vectors.schema["v"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if narrow else np.float64
    names = [f.split(" ")[0] for f in TILES.split(", ")]

    def run(batches):
        task, made, numbered, held = TaskContext.get().partitionId(), 0, 0, {}

        def tile(dim):
            nonlocal made, numbered
            ids, v = (np.concatenate(x) for x in zip(*held.pop(dim)))
            codes, steps, errors = quantised(v)
            rows = (task << 40) + np.arange(numbered, numbered + len(ids), dtype="<i8")
            made, numbered = made + 1, numbered + len(ids)
            row = (hash((task, made, dim)) % parts, dim, ids.astype("<i8").tobytes(), rows.tobytes(), codes.tobytes(), steps.tobytes(),
                   errors.tobytes(), v.astype(kind).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in row], names)

        for b in batches:
            for at in range(0, b.num_rows, TILE):
                part = b.slice(at, TILE)
                ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                dims = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.concatenate([[0], np.cumsum(dims)])
                for dim in np.unique(dims[dims > 0]).tolist():
                    mine = np.flatnonzero(dims == dim)
                    v = safe(flat[starts[mine][:, None] + np.arange(dim)])
                    some = lengths(v) > 0
                    if some.any():
                        held.setdefault(dim, []).append((ids[mine][some], v[some]))
                        if sum(len(x[0]) for x in held[dim]) >= TILE:
                            yield tile(dim)
        for dim in list(held):
            yield tile(dim)

    return vectors.mapInArrow(run, TILES)


class Tile:
    def __init__(self, row: dict):
        dim = row["dim"]
        self.dim, self.ids, self.rows = dim, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
        n = len(self.ids)
        # float holds sums of int8 products exactly while dim * 127 ** 2 fits its mantissa
        exact = np.float32 if dim * 127 ** 2 < 1 << 24 else np.float64
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, dim).astype(exact)
        self.steps, self.errors = np.frombuffer(row["steps"]), np.frombuffer(row["errors"])
        kind = np.float32 if len(row["vectors"]) == 4 * n * dim else np.float64
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, dim)
        self.rounded = self.steps * np.sqrt((self.codes.astype(np.float64) ** 2).sum(axis=1))


def search_tile(q: Tile, c: Tile, heaps: list[list], k: int) -> None:
    """Merge the k best candidates of one tile into the queries' heaps of (cosine, -id)."""
    near = (q.codes @ c.codes.T).astype(np.float64) * q.steps[:, None] * c.steps
    bound = q.rounded[:, None] * c.errors + q.errors[:, None] + SLACK
    near[q.ids[:, None] == c.ids] = -np.inf
    low = near - bound
    floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
    floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
    survive = (near + bound >= floor[:, None]) & (near > -np.inf)
    for i in np.flatnonzero(survive.any(axis=1)).tolist():
        mine = np.flatnonzero(survive[i])
        x, y = q.vectors[i].astype(np.float64), c.vectors[mine].astype(np.float64)
        score = (y * x).sum(axis=1) / (np.sqrt((x * x).sum()) * lengths(y))
        for j in np.lexsort((c.ids[mine], -score))[:k].tolist():
            entry = (float(score[j]), -int(c.ids[mine[j]]))
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], entry)
            elif entry > heaps[i][0]:
                heapq.heapreplace(heaps[i], entry)
            else:
                break


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            cell_candidates: int = 1 << 14, cell_queries: int = 1 << 14) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row where ``queries`` holds."""
    picked = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(queries, 1).otherwise(0)).alias("q")).first()
    rows, columns = -(-(size["q"] or 0) // cell_queries) or 1, -(-size["n"] // cell_candidates) or 1
    left = (tiles(picked.where("q").drop("q"), rows).withColumnRenamed("part", "g")
            .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))))
    right = (tiles(picked.drop("q"), columns).withColumnRenamed("part", "h")
             .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))))

    def cell(query_rows: pa.Table, candidate_rows: pa.Table) -> pa.Table:
        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        mine = [Tile(r) for r in query_rows.to_pylist()]
        heaps = [[[] for _ in t.ids] for t in mine]
        for batch in candidate_rows.to_batches(max_chunksize=1):
            c = Tile(batch.to_pylist()[0])
            for q, h in zip(mine, heaps):
                if q.dim == c.dim:
                    search_tile(q, c, h, k)
        for q, hs in zip(mine, heaps):
            for r, i, h in zip(q.rows.tolist(), q.ids.tolist(), hs):
                for score, j in h:
                    out["query_row"].append(r)
                    out["query_id"].append(i)
                    out["vec_id"].append(-j)
                    out["score"].append(score)
        return pa.table({n: pa.array(v, pa.float64() if n == "score" else pa.int64()) for n, v in out.items()})

    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(cell, FOUND)
    # every query row is ranked by itself: rows with one vec_id may hold different vectors
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
