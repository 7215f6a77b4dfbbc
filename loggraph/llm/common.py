"""Shared small helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loggraph.session import materialize

__all__ = ["blocks", "materialize", "only_held", "read_table", "slices", "text_or_empty", "packed", "unpacked"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, through Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """Every source column inside one struct ``row`` beside the operator's own
    columns, so that source columns of any name never clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *extra)


def unpacked(df: DataFrame, source: DataFrame) -> DataFrame:
    """Back from ``packed``: the source columns only, in their order."""
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in source.columns])


def slices(batches, rows: int = 500):
    """Arrow batches in slices of a few rows, so that a task holds few texts as Python
    strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def blocks(batches, chars: int, column: int = 1):
    """Slices of Arrow batches of at most about ``chars`` bytes in a text column, one row
    at least."""
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + chars, side="right")))
            yield b.slice(at, end - at)
            at = end


_HELD: dict = {}


def only_held(key, build):
    """A large helper (an encoder, a cache) that a Python worker keeps from task to
    task; it holds one at a time, so another operator's is let go first."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]
