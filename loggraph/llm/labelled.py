"""Bounded samples of labelled documents, and a small logistic fit."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only_held, slices, text_or_empty


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that no model may learn from: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text``, ``y`` and ``fold`` (0 to 4) of at most ``per_class`` labelled documents
    of each class that are not held out: those of ``docs`` with the smallest hash. Rows
    without doc_id or label are left out, as are documents with both labels."""
    there = docs.select(F.col(id_col).alias("there_id")).where("there_id IS NOT NULL")
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top")
             .select("doc_id", "y", F.xxhash64("doc_id", F.lit(11)).alias("h")))
    known = materialize(known.join(there, F.col("doc_id") == F.col("there_id"), "left_semi"), "labelled_ids")
    few = [known.where(F.col("y") == c).orderBy("h", "doc_id").limit(per_class) for c in (0, 1)]
    # at most 2 * per_class rows
    few = F.broadcast(few[0].unionByName(few[1]).withColumnRenamed("doc_id", "labelled_id"))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return materialize(texts.join(few, F.col("doc_id") == F.col("labelled_id"))
                       .select("text", F.col("y").cast("int").alias("y"), "h",
                               F.pmod(F.xxhash64("h", F.lit(4)), F.lit(5)).cast("int").alias("fold")), "labelled")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2,
                 steps: int = 60, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of a ridge logistic model by Newton steps from ``start`` (or zero);
    column 0 of ``x`` is the constant and is not penalised."""
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    c = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(steps):
        p = sigmoid(x @ c)
        gradient = x.T @ (weight * (p - y)) + penalty * c
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        c -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-3:
            break
    return c


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, id_col: str, text_col: str, names: list[str], score) -> DataFrame:
    """doc_id and the float columns ``names``; ``score()`` is called once a worker and
    gives a function from a text to their values."""
    key = uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        one = only_held(key, score)
        for b in slices(batches):
            values = [one(t) for t in b.column(1).to_pylist()]
            columns = [pa.array([v[k] for v in values], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *names])

    return rows.mapInArrow(run, ", ".join([f"doc_id {id_type}", *[f"{n} double" for n in names]]))


def passed(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The documents, all columns, whose text passes; ``keep()`` is called once a worker
    and gives a function from a text to whether it stays."""
    key = uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def run(batches):
        one = only_held(key, keep)
        for b in slices(batches):
            yield b.filter(pa.array([one(t or "") for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
