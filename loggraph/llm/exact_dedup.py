"""Operator 1: exact dedup by two-pass Bloom filtering (DataFrame functions only).

Pass one sets two hashed bits per row in one bit array and keeps the bits that were
hit at least twice. Pass two probes that filter: a row whose two bits are both
marked is possibly repeated; only those rows shuffle, to be grouped exactly by the
SHA-256 of the normalised text. Every other row passes straight through as the only
one of its text.

The bit array has ``bits_per_row`` bits a row, at most ``max_filter_bits``; it is
kept as 64-bit words, of which the non-zero ones are broadcast (at most
``max_filter_bits / 64`` rows, so the bound holds at any input size). Beyond that
size the filter lets more rows through and stays right.

Defined cases: null text counts as empty; empty texts equal each other; of rows with
equal text the smallest doc_id stays (null doc_id last), of repeated rows one; an
empty table gives an empty result; other columns are carried and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, packed, read_table, text_or_empty, unpacked

BLANKS = r"[\x20\x09-\x0D]+"
BITS_PER_ROW = 32
MAX_FILTER_BITS = 1 << 30


def normal_sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of blanks made one space."""
    return F.sha2(F.regexp_replace(text, BLANKS, " "), 256)


def _filter_bits(n_rows: int, bits_per_row: int, max_filter_bits: int) -> int:
    bits = 1 << 12
    while bits < bits_per_row * n_rows and bits < max_filter_bits:
        bits *= 2
    return bits


def _positions(sha: Column, bits: int) -> tuple[Column, Column]:
    return tuple(F.pmod(F.xxhash64(sha, F.lit(k)), F.lit(bits)).cast("long") for k in (1, 2))


def repeat_filter(digests: DataFrame, bits: int, sha: str = "sha") -> DataFrame:
    """Pass one: the words (``word``, ``marks``) of the bits that rows hit twice or more."""
    hits = digests.select(F.explode(F.array(*_positions(F.col(sha), bits))).alias("bit"))
    return (hits.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("marks")))


def probe(rows: DataFrame, words: DataFrame, bits: int, sha: str = "sha") -> DataFrame:
    """Pass two: add ``maybe``, false for a row whose text is certainly alone."""
    out = rows
    for k, pos in enumerate(_positions(F.col(sha), bits)):
        side = F.broadcast(words.select(F.col("word").alias(f"word{k}"), F.col("marks").alias(f"marks{k}")))
        out = (out.withColumn(f"bit{k}", pos)
               .join(side, F.shiftright(f"bit{k}", 6) == F.col(f"word{k}"), "left"))
    seen = [F.coalesce(F.expr(f"getbit(marks{k}, CAST(bit{k} & 63 AS INT))") == 1, F.lit(False))
            for k in (0, 1)]
    return out.withColumn("maybe", seen[0] & seen[1]).drop(
        *[f"{c}{k}" for c in ("bit", "word", "marks") for k in (0, 1)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = BITS_PER_ROW, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    sha = normal_sha256(text_or_empty(text_col))
    digests = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(sha).alias("sha"),
        F.monotonically_increasing_id().alias("rid")), "dedup_digests")
    bits = _filter_bits(digests.count(), bits_per_row, max_filter_bits)
    probed = probe(digests, materialize(repeat_filter(digests, bits), "dedup_filter"), bits)
    alone = probed.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")
    maybe = probed.where("maybe")
    groups = maybe.groupBy("sha").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("keep"),
        F.count(F.lit(1)).alias("group_size"))
    grouped = maybe.join(groups, "sha").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"), "sha")
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = BITS_PER_ROW, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The documents that stay, all columns. Rows that the filter clears never
    shuffle; of the others each task first reduces its copies to one row."""
    sha = F.unhex(normal_sha256(text_or_empty(text_col))).alias("sha")
    digests = materialize(docs.select(sha), "dedup_digests")
    bits = _filter_bits(digests.count(), bits_per_row, max_filter_bits)
    words = materialize(repeat_filter(digests, bits), "dedup_filter")
    rows = probe(packed(docs, sha, F.col(id_col).alias("id")), words, bits)
    alone = rows.where(~F.col("maybe")).select("row")
    first = (rows.where("maybe").groupBy("sha")
             .agg(F.min_by("row", F.struct(F.col("id").isNull(), "id")).alias("row")).select("row"))
    return unpacked(alone.unionByName(first), docs)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
