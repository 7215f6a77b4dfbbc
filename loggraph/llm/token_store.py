"""Operator 5: token ids in a binary store with a shared zstandard dictionary.

Every whole text is encoded, an end id appended, and the ids, as little-endian
unsigned 32-bit integers, compressed as one zstandard frame per document with a
dictionary trained on serialized id arrays. Frames in ascending doc_id order are
concatenated into blocks. One stored row is one block::

    shard, block     place of the block (ascending doc_id over both)
    dict_hash        SHA-256 of the dictionary that its frames need
    first_id/last_id smallest and largest doc_id, for pruning by file statistics
    doc_ids          the documents in order
    offsets          start of each document's frame in ``frames``, and the end
    n_tokens         ids of each document, end id included
    frames           the frames, one after another

A short document is read by its block's offset index and one frame, nothing else. The
dictionary lies beside the blocks under its hash. Spark's writer commits the files, so
lost executors leave no half-written store, on any file system Spark can write.

The dictionary is trained on a bounded sample: the id arrays of about ``sample_docs``
random documents of any length, cut into pieces of ``piece_ids`` ids, of a document at
most ``doc_pieces`` spread evenly over all of it. It changes sizes only, never what is
read back.

Defined cases: null text is the empty text (the end id alone); null doc_ids come
first; rows with the same doc_id stand side by side, ordered by the text's hash; an
empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loggraph.session import ensure_checkpoint_dir

from .byte_bpe import byte_bpe
from .common import blocks as text_blocks
from .common import materialize, read_table, text_or_empty

LEVEL = 3
DICT_BYTES = 64 << 10
BLOCK_BYTES = 4 << 20
OUT_BYTES = 4 << 20
#: Text that a task encodes at once: in more text a distinct word is met more often.
TEXT_BYTES = 8 << 20
END = np.zeros(1, dtype="<u4").tobytes()

ENCODED = "doc_id long, tie long, n_tokens long, frame binary"
BLOCKS = ("shard int, block int, dict_hash string, first_id long, last_id long, doc_ids array<long>, "
          "offsets array<long>, n_tokens array<long>, frames binary")
READ = "doc_id long, shard int, block int, place int, n_tokens long, ids binary"


def _schema(ddl_df_fields) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.strip().split(" ") for f in ddl_df_fields.split(","))])


def _batches(rows, schema: pa.Schema, size_of):
    """Arrow batches of at most about OUT_BYTES of what ``size_of`` measures."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += size_of(row) + 64
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)


def pieces(ids: bytes, piece_ids: int, most: int) -> list[bytes]:
    """``ids`` in pieces; of more than ``most`` those at even distances, last one included."""
    cut = [ids[at:at + 4 * piece_ids] for at in range(0, len(ids), 4 * piece_ids)]
    if len(cut) <= most:
        return cut
    return [cut[round(k * (len(cut) - 1) / max(1, most - 1))] for k in range(most)]


def sample_arrays(docs: DataFrame, tokenizer: str, sample_docs: int, piece_ids: int, doc_pieces: int) -> list[bytes]:
    """The bounded training sample of serialized id arrays."""
    few = docs.sample(min(1.0, sample_docs / max(1, docs.count())), seed=5).select("text")

    def encode(batches):
        bpe = byte_bpe(tokenizer)
        for b in text_blocks(batches, TEXT_BYTES, 0):
            cut = [p for ids in bpe.many(b.column(0)) for p in pieces(ids + END, piece_ids, doc_pieces)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["ids"])

    return [bytes(r["ids"]) for r in few.mapInArrow(encode, "ids binary").collect()]


def train_dictionary(arrays: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes; empty where the sample is too small for one."""
    import zstandard

    total = sum(map(len, arrays))
    if len(arrays) < 16 or total < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 4), arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    more = {"dict_data": d} if d else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **more), zstandard.ZstdDecompressor(**more)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 sample_docs: int = 1000, piece_ids: int = 1024, doc_pieces: int = 8) -> str:
    """Write the store of ``docs`` under ``path``; returns the dictionary's hash."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dictionary = train_dictionary(sample_arrays(docs, tokenizer, sample_docs, piece_ids, doc_pieces))
    name = hashlib.sha256(dictionary).hexdigest()
    encoded, blocks = _schema(ENCODED), _schema(BLOCKS)

    def encode(batches):
        bpe, (compressor, _) = byte_bpe(tokenizer), _codec(dictionary)

        def rows():
            for b in text_blocks(batches, TEXT_BYTES, 2):
                for doc_id, tie, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), bpe.many(b.column(2))):
                    ids += END
                    yield doc_id, tie, len(ids) // 4, compressor.compress(ids)

        yield from _batches(rows(), encoded, lambda r: len(r[3]))

    def gather(batches):
        shard, held, size, block = TaskContext.get().partitionId(), [], 0, 0

        def row():
            offsets = np.cumsum([0] + [len(f) for _, _, f in held]).tolist()
            known = [i for i, _, _ in held if i is not None]
            return (shard, block, name, min(known, default=None), max(known, default=None), [i for i, _, _ in held],
                    offsets, [n for _, n, _ in held], b"".join(f for _, _, f in held))

        for b in batches:
            for doc_id, n, frame in zip(*(c.to_pylist() for c in b.columns)):
                if held and size + len(frame) > BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist([dict(zip(blocks.names, row()))], schema=blocks)
                    held, size, block = [], 0, block + 1
                held.append((doc_id, n, frame))
                size += len(frame)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(blocks.names, row()))], schema=blocks)

    frames = materialize(docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(encode, ENCODED),
                         "token_frames")
    (frames.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
     .select("doc_id", "n_tokens", "frame").mapInArrow(gather, BLOCKS)
     .write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks"))
    (spark.createDataFrame([(name, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/dictionary"))
    return name


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """Documents of a store as (doc_id, shard, block, place, n_tokens, ids). With
    ``doc_id`` only its blocks are read and only its frames are decompressed."""
    stored = {r["dict_hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    blocks, schema = spark.read.parquet(f"{path}/blocks"), _schema(READ)
    if doc_id is not None:
        blocks = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def decode(batches):
        codecs = {}

        def rows():
            for b in batches:
                for r in b.to_pylist():
                    if r["dict_hash"] not in codecs:
                        dictionary = stored[r["dict_hash"]]
                        if hashlib.sha256(dictionary).hexdigest() != r["dict_hash"]:
                            raise ValueError("the dictionary is not the one the frames were written with")
                        codecs[r["dict_hash"]] = _codec(dictionary)[1]
                    frames, offsets = memoryview(r["frames"]), r["offsets"]
                    for k, (i, n) in enumerate(zip(r["doc_ids"], r["n_tokens"])):
                        if doc_id is None or i == doc_id:
                            ids = codecs[r["dict_hash"]].decompress(frames[offsets[k]:offsets[k + 1]])
                            if len(ids) != 4 * n:
                                raise ValueError(f"document {i}: {len(ids) // 4} ids read, {n} written")
                            yield i, r["shard"], r["block"], k, n, ids

        yield from _batches(rows(), schema, lambda r: len(r[5]))

    return (blocks.select("shard", "block", "dict_hash", "doc_ids", "offsets", "n_tokens", "frames")
            .mapInArrow(decode, READ))


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """Per block the ids of all blocks before it: ids are summed per shard, the few
    shard sums are accumulated, then the blocks of each shard."""
    sums = spark.read.parquet(f"{path}/blocks").select(
        "shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n"))
    up_to = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("shard_start"))
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (sums.withColumn("block_start", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(shards, "shard")
            .select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start")))


def op5_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token_store-{uuid.uuid4().hex}"
    write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    rows = read_tokens(spark, path).select("doc_id", "shard", "block", "place", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    inner = Window.partitionBy("shard", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
            .join(token_starts(spark, path), ["shard", "block"])
            .select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"))
