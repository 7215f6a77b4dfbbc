"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over edges (u, v). The smallest neighbour of each node comes from
    a combinable aggregate that is joined back, so a node with very many edges is split
    like any hot join key."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if not small:
        both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        both = both.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    near = both.join(low, "x")
    if small:
        out = near.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(
            low.select(F.col("x").alias("u"), F.col("m").alias("v")))
    else:
        out = near.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges ``u``, ``v`` (longs); the root is the
    smallest node of the component. Each round is written to the shared folder."""
    edges = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        edges = materialize(_star(_star(edges, small=False), small=True), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
