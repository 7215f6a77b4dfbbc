"""Corpus pipeline over ``documents``: quality, toxicity, exact copies, near copies,
packing. Each stage's result is written as Parquet and read again as the next one's
documents; all but the last return the columns of ``documents``.

Defined cases are those of the operators: null texts count as empty, other columns are
carried, an empty table runs through to an empty result.

The stages share executors, whose heaps and Python workers stay from stage to stage, so
each stage bounds the bytes of the batches of rows that its workers get at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loggraph.llm.common import materialize, read_table
from loggraph.llm.exact_dedup import drop_copies
from loggraph.llm.ngram_join import drop_near_copies
from loggraph.llm.packing import pack
from loggraph.llm.quality import keep_good
from loggraph.llm.toxicity import drop_toxic
from loggraph.session import small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


@_in_small_batches
def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the quality classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


@_in_small_batches
def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the toxicity chain rejects go."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


@_in_small_batches
def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts one document stays."""
    return drop_copies(docs)


@_in_small_batches
def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 with five words and a similarity of 0.8: one document of each class
    of near copies stays."""
    return drop_near_copies(docs)


@_in_small_batches
def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents that are left, packed into sequences."""
    import public_tokenizers

    # a smaller cache than alone: the workers still hold memory of the stages before
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept_words=200_000)


STAGES = [
    ("quality", stage_quality),
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact_dedup),
    ("near_copies", stage_near_copies),
    ("packing", stage_packing),
]

#: Classifiers and packing have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
