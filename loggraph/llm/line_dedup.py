"""Operator 8: line dedup (DataFrame functions only).

Lines are exploded with their position, normalised to a key and hashed (two 64-bit
hashes). Per key the smallest and largest document are kept, both combinable on the
map side, so a line that a third of all documents share costs one row a task. Keys
found in at least two documents are joined back to the narrow line rows (AQE splits a
hot key of that join), the positions to drop are gathered per document, and the text
is put together again from the positions that stay.

Defined cases: null or empty text is one empty line; keys under ``min_length`` code
points never drop; rows with the same doc_id are one document; a null doc_id counts
as one document after all others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, text_or_empty

TRIM = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 9223372036854775807


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased (other letters as they are)."""
    bare = F.btrim(line, F.lit(TRIM))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_length: int = 10) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and ``kept_text``."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
    lines = (base.select("d", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
             .withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_length)
             .select("d", "t", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("2"), "key").alias("k2")))
    lines = materialize(lines, "line_keys")
    shared = (lines.groupBy("k1", "k2").agg(F.min("d").alias("first"), F.max("d").alias("last"))
              .where("first < last").select("k1", "k2", "first"))
    dropped = (lines.join(shared, ["k1", "k2"]).where(F.col("d") != F.col("first"))
               .groupBy("d", "t").agg(F.collect_set("pos").alias("gone")))
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    whole = base.withColumn("t", F.xxhash64("text")).join(dropped, ["d", "t"], "left")
    return whole.select(
        "doc_id", F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda p: F.get(parts, p)), "\n")).alias("kept_text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
