"""Operator 7: toxicity by a classifier chain.

The label says only whether a document is toxic, so the categories are found in the
labelled text: marks (words, and word beginnings of four letters and more) that are
stronger in toxic documents than chance explains are grouped by the documents they share;
each of the ``n_categories`` largest groups is a category, and a labelled document belongs
to it when it is toxic and holds a mark of the group. The chain predicts the categories
one after another and toxicity last. Every link is a linear (logistic) model over how
often the document holds each mark, and also sees the probabilities of the links before
it; in training these are out-of-fold predictions, so a link learns from probabilities as
good as those it will meet.

All marks above the strength bound count, however many; documents are sparse rows of them
and the links are fitted by accelerated gradient steps. Learning uses at most
``per_class`` labelled documents of each class (smallest id hash, none of the held-out
ids). Whole texts of all documents are scored, each document by all of its words.

Defined cases: null or empty text has no marks; with fewer than 16 labelled documents
of a class every probability is the share of toxic labels (0 without labels) and no
document counts as toxic unless that share reaches the threshold; missing categories score 0; an empty
table gives an empty result; label, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import Kept
from .common import materialize, read_table, slices
from .labelled import held_out, labelled_sample, passed, scored, sigmoid

WORD = re.compile(r"[^\W\d_]{3,}")
THRESHOLD = 0.5
FOLDS = 5
#: Toxic documents that a mark is in at least, and its strength in standard errors.
LEAST_DOCS, STRENGTH = 4, 3.0
#: Share of the toxic training documents that hold a mark which decides alone.
SURE = 0.03


def word_marks(word: str) -> list[str]:
    """A word and its shorter beginnings from four letters on, with a star."""
    return [word] + [word[:k] + "*" for k in range(4, len(word))]


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


class Rows:
    """Sparse rows: ``values`` of the columns ``at`` of row ``row``, and ``n`` x ``width``."""

    def __init__(self, row: np.ndarray, at: np.ndarray, values: np.ndarray, n: int, width: int):
        self.row, self.at, self.values, self.n, self.width = row, at, values, n, width

    def dot(self, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * c[self.at], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.values * r[self.row], self.width)

    def pick(self, some: np.ndarray) -> "Rows":
        """The rows where ``some`` holds."""
        held, place = some[self.row], np.cumsum(some) - 1
        return Rows(place[self.row[held]], self.at[held], self.values[held], int(some.sum()), self.width)

    def beside(self, more: np.ndarray) -> "Rows":
        """These rows with further dense columns."""
        r, c = np.indices(more.shape)
        return Rows(np.concatenate([self.row, r.ravel()]), np.concatenate([self.at, self.width + c.ravel()]),
                    np.concatenate([self.values, more.ravel()]), self.n, self.width + more.shape[1])


def fit_sparse(x: Rows, y: np.ndarray, ridge: float, steps: int = 150, start: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic coefficients (a constant first) by accelerated gradient steps."""
    scale = np.bincount(x.at, x.values ** 2, x.width)
    scale = np.concatenate([[x.n], scale]) / 4 + ridge  # bounds the curvature of each column
    penalty = np.concatenate([[1e-6], np.full(x.width, ridge)])
    # rows hold several marks at once: the step is shared out among them
    load = max(1.0, float(np.bincount(x.row, x.values > 0, x.n).max()) + 1) if len(x.row) else 1.0
    step = 1 / (scale * load ** 0.5)
    c = np.zeros(x.width + 1) if start is None else start.copy()
    ahead, t, last = c.copy(), 1.0, np.inf
    for _ in range(steps):
        z = ahead[0] + x.dot(ahead[1:])
        loss = np.logaddexp(0, z).sum() - (y * z).sum() + (penalty * ahead ** 2).sum() / 2
        r = sigmoid(z) - y
        gradient = np.concatenate([[r.sum()], x.back(r)]) + penalty * ahead
        if loss > last:  # too far: smaller steps from the last point
            step, ahead, t, last = step / 2, c.copy(), 1.0, np.inf
            continue
        new = ahead - step * gradient
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, c, t, last = new + (t - 1) / t_new * (new - c), new, t_new, loss
        if np.abs(step * gradient).max() < 1e-3:
            break
    return c


class ToxicityModel:
    """The places of the marks and the chain's coefficients (constant, marks, earlier
    links). A common mark that no clean training document holds has a second place, the last
    one, which all of them share: one of them alone then says as much as several."""

    def __init__(self, share: float, n_categories: int, places: dict[str, tuple[int, ...]] | None = None,
                 links: list[np.ndarray] = ()):
        self.share, self.n_categories = share, n_categories
        self.places, self.links = places or {}, list(links)
        self.n_places = len(self.places) + 1

    def scorer(self):
        """Text -> category probabilities, then the toxic probability."""
        none = (0.0,) * (self.n_categories + 1 - len(self.links))
        if not self.links:
            return lambda text: (0.0,) * self.n_categories + (self.share,)
        found = Kept(lambda w: places_of(w, self.places), 150_000)

        def one(text: str):
            seen = seen_places(words_of(text), found)
            return chain(self.links, sorted(seen), [seen[k] for k in sorted(seen)], self.n_places, none)

        return one


def places_of(word: str, places: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
    return tuple(k for m in word_marks(word) for k in places.get(m, ()))


def seen_places(words: Counter, found) -> dict[int, float]:
    """Place -> log2(1 + number of the document's words that hold it)."""
    seen = Counter()
    for w, n in words.items():
        for k in found[w]:
            seen[k] += n
    return {k: math.log2(1 + n) for k, n in seen.items()}


def chain(links, seen, values, n_marks, none) -> tuple[float, ...]:
    """Probabilities of all links; ``none`` stands in for missing categories."""
    out = []
    for coef in links:
        z = coef[0] + np.dot(coef[1:n_marks + 1][seen], values) + np.dot(coef[n_marks + 1:], out)
        out.append(float(sigmoid(z)))
    return (*out[:-1], *none, out[-1])


def fit_chain(x: Rows, targets: list[np.ndarray], fold: np.ndarray, ridge: float = 0.3) -> list[np.ndarray]:
    """One coefficient vector per link."""
    links = []
    for k, y in enumerate(targets):
        links.append(fit_sparse(x, y, ridge))
        if k == len(targets) - 1:
            break
        out = np.zeros(x.n)
        for f in range(FOLDS):
            rest, mine = fold != f, fold == f
            if rest.any() and mine.any():
                c = fit_sparse(x.pick(rest), y[rest], ridge, steps=40, start=links[-1])
                out[mine] = sigmoid(c[0] + x.pick(mine).dot(c[1:]))
        x = x.beside(out[:, None])
    return links


def find_categories(x: np.ndarray, toxic: np.ndarray, n_categories: int) -> list[np.ndarray]:
    """Groups of the columns of ``x`` (documents x marks, above 0 where held): the mark
    in most toxic documents that are not covered yet opens a group; marks join the group
    they share most toxic documents with."""
    t = x[toxic == 1] > 0
    heads, covered = [], np.zeros(len(t), dtype=bool)
    for _ in range(n_categories):
        gain = t[~covered].sum(axis=0)
        if not len(gain) or gain.max() < 8:
            break
        heads.append(int(gain.argmax()))
        # the group's documents: those with its head or a mark that mostly goes with it
        with_head = t[t[:, heads[-1]]].sum(axis=0) / np.maximum(1, t.sum(axis=0)) >= 0.3
        covered |= t[:, with_head].any(axis=1)
    if not heads:
        return []
    together = np.stack([t[t[:, h]].sum(axis=0) / max(1, t[:, h].sum()) for h in heads])
    group = together.argmax(axis=0)
    return [np.flatnonzero((group == g) & t.any(axis=0)) for g in range(len(heads))]


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   per_class: int = 6000, strength: float = STRENGTH, n_categories: int = 4) -> ToxicityModel:
    """Fit on labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / (sum(counts.values()) + 1)
    sample = labelled_sample(docs, labels, "toxic", per_class, id_col, text_col)

    def spread(batches):
        for b in slices(batches):
            held = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[y].update({m for w in words_of(text) for m in word_marks(w)})
            for y in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(held[y]), pa.string()), pa.array([y] * len(held[y]), pa.int32()),
                                                  pa.array(list(held[y].values()), pa.int64())], ["mark", "y", "n"])

    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(size.get(0, 0), size.get(1, 0)) < 16:
        return ToxicityModel(share, n_categories)
    spread_marks = materialize(sample.mapInArrow(spread, "mark string, y int, n long"), "toxic_marks")
    # share of toxic documents with the mark against the share of others, in standard errors
    p1, p0 = (F.col("n1") + 0.5) / (size[1] + 1), (F.col("n0") + 0.5) / (size[0] + 1)
    errors = (p1 - p0) / F.sqrt(p1 * (1 - p1) / size[1] + p0 * (1 - p0) / size[0])
    n_of = {y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) for y in (0, 1)}
    marks = (spread_marks.groupBy("mark").agg(n_of[1].alias("n1"), n_of[0].alias("n0"))
             .where((F.col("n1") >= LEAST_DOCS) & (errors >= strength)).select("mark", "n0", "n1"))
    # at most words of 2 * per_class documents, far fewer beyond the bound
    top = sorted(marks.collect())
    places = {r["mark"]: (k, len(top)) if r["n0"] == 0 and r["n1"] >= SURE * size[1] else (k,) for k, r in enumerate(top)}

    def rows_of(batches):
        found = Kept(lambda w: places_of(w, places), 150_000)
        for b in slices(batches):
            texts, ys, _, folds = (c.to_pylist() for c in b.columns)
            seen = [sorted(seen_places(words_of(t), found).items()) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array(ys, pa.int32()), pa.array(folds, pa.int32()), pa.array([[k for k, _ in s] for s in seen], pa.list_(pa.int32())),
                pa.array([[v for _, v in s] for s in seen], pa.list_(pa.float64()))], ["y", "fold", "seen", "held"])

    rows = sorted(sample.mapInArrow(rows_of, "y int, fold int, seen array<int>, held array<double>").collect())
    lengths = [len(r["seen"]) for r in rows]
    at = np.concatenate([r["seen"] for r in rows if r["seen"]]).astype(np.int64) if any(lengths) else np.zeros(0, np.int64)
    values = np.concatenate([r["held"] for r in rows if r["seen"]]) if any(lengths) else np.zeros(0)
    x = Rows(np.repeat(np.arange(len(rows)), lengths), at, values, len(rows), len(top) + 1)
    toxic, fold = np.array([r["y"] for r in rows], dtype=float), np.array([r["fold"] for r in rows])
    mine = x.pick(toxic == 1)
    t = np.zeros((mine.n, len(top)), dtype=bool)
    single = mine.at < len(top)
    t[mine.row[single], mine.at[single]] = True
    targets = []
    for g in find_categories(t, np.ones(len(t)), n_categories):
        inside = np.isin(x.at, g)
        targets.append(toxic * (np.bincount(x.row[inside], minlength=x.n) > 0))
    return ToxicityModel(share, n_categories, places, fit_chain(x, [*targets, toxic], fold))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``category_1`` ... and ``score``, the probability of label 1."""
    names = [f"category_{k + 1}" for k in range(model.n_categories)] + ["score"]
    return scored(docs, id_col, text_col, names, model.scorer)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose toxic probability is below ``threshold``."""
    model = train_toxicity(docs, labels, id_col, text_col)

    def keep():
        one = model.scorer()
        return lambda text: one(text)[-1] < threshold

    return passed(docs, text_col, keep)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = score_toxicity(docs, train_toxicity(docs, labels))
    return out.withColumn("held_out", held_out()).withColumn("toxic", (F.col("score") >= THRESHOLD).cast("int"))
