"""Operator 4: quality by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text.
A text is cut into pieces of ``PIECE`` bytes (all of them, so the dictionaries count
alike over the whole text), each compressed with either dictionary, and the sizes are
summed to ``g`` and ``b``. The inputs of the score are the normalised differences
``(b - g) / max(b, g)`` and ``(n - g) / n`` with ``n`` the raw size, and log ``n``, to
second order; a logistic model calibrates them to the probability of label 1.

Learning uses at most ``per_class`` labelled documents of each class (those with the
smallest id hash, none of the held-out ids); the dictionaries take half of them, the
calibration the other half, weighted back to the classes' true shares. A dictionary is
built from at most ``dict_text`` bytes: of each document, of any length, at most
``SPREAD`` pieces spread evenly from its first to its last. Whole texts of all documents
are scored.

Defined cases: null text is the empty text, which scores like the shortest texts; with
fewer than 16 labelled documents of a class every score is the share of label 1,
smoothed; an empty table gives an empty result; label, lang, source and doc_id are no
inputs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices
from .labelled import fit_logistic, held_out, labelled_sample, passed, scored, sigmoid

PIECE = 2048
SPREAD = 8
LEVEL = 3
DICT_BYTES = 112 << 10
THRESHOLD = 0.3


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8")
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


def spread_pieces(text: str) -> list[bytes]:
    """At most ``SPREAD`` pieces of a text, from its first to its last."""
    parts = pieces(text)
    if len(parts) <= SPREAD:
        return parts
    return [parts[k * (len(parts) - 1) // (SPREAD - 1)] for k in range(SPREAD)]


class Sizer:
    """Normalised compressed-size differences of a text under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.compressors = [zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
            write_checksum=False, write_dict_id=False) for d in (good, bad)]

    def __call__(self, text: str) -> list[float]:
        parts = pieces(text)
        n = sum(map(len, parts))
        g, b = (sum(len(c.compress(p)) for p in parts) for c in self.compressors)
        between = (b - g) / max(b, g, 1)
        gain, size = (n - g) / n if n else 0.0, math.log1p(n) / 10
        return [1.0, between, gain, size, between * between, gain * gain, size * size, between * gain, between * size, gain * size]


class QualityModel:
    """Dictionaries and calibration; without them (too few labels) a constant share."""

    def __init__(self, share: float, good: bytes = b"", bad: bytes = b"", centre=None, scale=None, coef=None):
        self.share, self.good, self.bad = share, good, bad
        self.centre, self.scale, self.coef = centre, scale, coef

    def scorer(self):
        if self.coef is None:
            return lambda text: (self.share,)
        sizer = Sizer(self.good, self.bad)
        return lambda text: (float(sigmoid(((np.array(sizer(text)) - self.centre) / self.scale) @ self.coef)),)


def _dictionary(texts: list[list[bytes]], dict_text: int) -> bytes:
    import zstandard

    samples, size = [], 0
    for parts in texts:
        for p in parts:
            if size < dict_text and len(p) >= 8:
                samples.append(p)
                size += len(p)
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(512, size // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # a sample too small to train on: its own text is the dictionary
        return b"".join(samples)[-DICT_BYTES:].ljust(8, b" ")


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  per_class: int = 8000, dict_text: int = 6 << 20) -> QualityModel:
    """Fit on labelled rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out())
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    sample = labelled_sample(docs, labels, "quality", per_class, id_col, text_col)
    # at most 2 * per_class hashes; the halves of a class differ by one document at most
    hashes = {y: sorted(r["h"] for r in sample.where(F.col("y") == y).select("h").distinct().collect()) for y in (1, 0)}
    if min(map(len, hashes.values())) < 16:
        return QualityModel(share)
    sample = sample.withColumn("half", (F.col("h") >= F.when(F.col("y") == 1, hashes[1][len(hashes[1]) // 2])
                                        .otherwise(hashes[0][len(hashes[0]) // 2])).cast("int"))

    def cut(batches):
        for b in slices(batches, 50):
            parts = [spread_pieces(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.binary()))], ["h", "parts"])

    dictionaries = []
    for y in (1, 0):
        # at most SPREAD pieces a document reach the driver; they are added in hash order while they fit
        rows = (sample.where((F.col("y") == y) & (F.col("half") == 0)).select("h", "text").mapInArrow(cut, "h long, parts array<binary>")
                .orderBy("h").limit(max(16, dict_text // (4 << 10))).select("parts").collect())
        dictionaries.append(_dictionary([[bytes(p) for p in r["parts"]] for r in rows], dict_text))
    good, bad = dictionaries

    def sizes():
        sizer = Sizer(good, bad)
        return lambda text: sizer(text)

    names = [f"f{k}" for k in range(10)]
    rest = sample.where("half = 1")
    rows = scored(rest.withColumn("id", F.col("y")), "id", "text", names, sizes).collect()
    y = np.array([r["doc_id"] for r in rows], dtype=float)
    x = np.array([[r[n] for n in names] for r in rows])
    centre, scale = x.mean(0), x.std(0)
    centre[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    coef = fit_logistic((x - centre) / scale, y, weight)
    return QualityModel(share, good, bad, centre, scale, coef)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``score`` of every document."""
    return scored(docs, id_col, text_col, ["score"], model.scorer)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The documents, all columns, that score at least ``threshold``."""
    model = train_quality(docs, labels, id_col, text_col)

    def keep():
        one = model.scorer()
        return lambda text: one(text)[0] >= threshold

    return passed(docs, text_col, keep)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = score_quality(docs, train_quality(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
