"""Operator 6: packing by power-of-two decomposition.

A document's ids (its end id included) are cut into as many pieces of ``max_length``
as fit, and the rest into the powers of two of its binary form. Equal lengths form a
bucket, and each piece is one sequence of its bucket: no sequence crosses documents
and none is padded. Batches are made of one bucket's sequences.

Sequences are numbered gapless, bucket by bucket (longest first). Each task numbers
its own pieces per bucket while it writes them; only the counts per task and bucket
are accumulated to make the numbers global.

Defined cases: null text is the empty text (one piece: the end id); rows with the same
or no doc_id are packed as they are; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import KEPT_WORDS, byte_bpe
from .common import blocks, materialize, read_table, text_or_empty

PIECES = ("doc_id long, start long, length long, doc_tokens long, bucket int, task int, number long, ids binary")
OUT_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
BROADCAST_ROWS = 1_000_000
END = np.zeros(1, dtype="<u4").tobytes()


def pieces_of(n: int, max_length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ``max_length`` ones, then the
    powers of two of the rest, largest first. ``max_length`` is a power of two."""
    out = [(s, max_length) for s in range(0, n - max_length + 1, max_length)]
    at, rest = len(out) * max_length, n % max_length
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((at, length))
        at, rest = at + length, rest - length
    return out


def pack(docs: DataFrame, tokenizer: str, max_length: int = 1024, id_col: str = "doc_id",
         text_col: str = "text", kept_words: int = KEPT_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (log2 of the
    length), sequence_id, offset, ids (little-endian uint32). ``kept_words`` bounds the
    memory of a task (see ``byte_bpe``)."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
    names = [f.split(" ")[0] for f in PIECES.split(", ")]

    def cut(batches):
        bpe, task, counts = byte_bpe(tokenizer, kept_words), TaskContext.get().partitionId(), {}
        out, size = [[] for _ in names], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

        for b in blocks(batches, BLOCK_BYTES):
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                ids = bpe.ids(text) + END
                n = len(ids) // 4
                for start, length in pieces_of(n, max_length):
                    bucket = length.bit_length() - 1
                    number = counts[bucket] = counts.get(bucket, -1) + 1
                    row = (doc_id, start, length, n, bucket, task, number, ids[4 * start:4 * (start + length)])
                    for c, v in zip(out, row):
                        c.append(v)
                size += len(ids)
                if size >= OUT_BYTES:
                    yield batch()
                    out, size = [[] for _ in names], 0
        if out[0]:
            yield batch()

    pieces = materialize(docs.mapInArrow(cut, PIECES), "packed_pieces", compression="zstd")
    counts = pieces.groupBy("bucket", "task").agg(F.count(F.lit(1)).alias("n"))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n"))
    # at most log2(max_length) + 1 rows in the one window, one row per task in the other
    longer = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("bucket", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("bucket_base"))
    earlier = Window.partitionBy("bucket").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = (counts.withColumn("task_base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
             .join(F.broadcast(buckets), "bucket")
             .select("bucket", "task", (F.col("bucket_base") + F.col("task_base")).alias("base")))
    # a few rows per task that cut the pieces: broadcast while they are few, so that the
    # ids do not shuffle
    if counts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    return (pieces.join(bases, ["bucket", "task"])
            .select("doc_id", "start", "length", "doc_tokens", "bucket",
                    (F.col("base") + F.col("number")).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"), "ids"))


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    out = pack(read_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")
