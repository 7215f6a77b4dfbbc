"""Operator 10: sharding by vector bin packing.

Groups of equal text have a vector (rows, bytes, tokens); a token is here a piece of text
between blanks, no id of a tokenizer, so a text without blanks counts one and is balanced
by its bytes and row alone. The packed items are mostly not single groups:

* chunks of heavy groups: a group above ``1 / (n_shards * HEAVY)`` of a total is cut
  into chunks of about that size, so a group of a third of all rows still spreads;
  at most ``3 * n_shards * HEAVY`` groups can be that heavy, whatever the input;
* bundles: all lighter groups, hashed whole into ``n_bundles`` bundles.

The driver sees only the items' sums (bounded by the parameters, not by the data).
Items go, largest first, to the shard where the dot product of the item's vector with
the shard's residual capacity is highest. Rows then take their item's shard and a
slot that is gapless in the shard, numbered per slice with slice offsets.

Defined cases: null text has 0 bytes; rows with any or no doc_id are placed; an empty
table gives an empty result; equal texts stay together unless their group is heavy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, text_or_empty

HEAVY = 16
DIMS = ["n_rows", "n_bytes", "n_tokens"]


def place(items: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each item (rows of normalised vectors): largest items first, each
    to the highest dot product with the residual capacity, ties to the lower shard."""
    residual = np.full((n_shards, items.shape[1]), 1.0 / n_shards)
    where = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        where[i] = int(np.argmax(residual @ items[i]))
        residual[where[i]] -= items[i]
    return where


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                    n_bundles: int = 4096, rows_per_slice: int = 200_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.size(F.split(text, r"\s+", -1)).cast("long").alias("tokens"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("2"), text).alias("g2")), "shard_rows")
    sums = [F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), F.sum("tokens").alias("n_tokens")]
    total = rows.agg(*sums).first()
    if not total["n_rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(*[F.col(c) / F.lit(max(1, total[c])) for c in DIMS])
    heavy = (rows.groupBy("g1", "g2").agg(*sums).select("g1", "g2", F.ceil(share * n_shards * HEAVY).alias("chunks"))
             .where("chunks > 1"))
    # at most 3 * n_shards * HEAVY rows can be heavy, so this side may be broadcast
    rows = rows.join(F.broadcast(heavy), ["g1", "g2"], "left").withColumn(
        "item", F.when(F.col("chunks").isNull(), F.concat(F.lit("b"), F.pmod("g1", F.lit(n_bundles))))
        .otherwise(F.concat_ws("/", F.hex("g1"), F.hex("g2"), F.pmod(F.xxhash64("rid"), F.col("chunks")))))
    rows = materialize(rows.drop("chunks", "g1", "g2", "tokens").join(
        F.broadcast(_placed(spark, rows.groupBy("item").agg(*sums).toPandas(), total, n_shards)), "item").drop("item"),
        "shard_placed")
    n_slices = max(8, -(-total["n_rows"] // (n_shards * rows_per_slice)))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(n_slices)).cast("int"))
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "slice", F.coalesce(before, F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "rid"))
    return (rows.withColumn("number", number).join(offsets, ["shard", "slice"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("number") - 1).alias("slot")))


def _placed(spark: SparkSession, items, total, n_shards: int) -> DataFrame:
    items = items.sort_values("item").reset_index(drop=True)
    vectors = np.stack([items[c].to_numpy(float) / max(1, total[c]) for c in DIMS], axis=1)
    pairs = list(zip(items["item"].tolist(), place(vectors, n_shards).tolist()))
    return spark.createDataFrame(pairs, "item string, shard int")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
