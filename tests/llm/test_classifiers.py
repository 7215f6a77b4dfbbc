"""Operators 4 and 7: held-out accuracy and the defined cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loggraph.llm.labelled import fit_logistic, held_out, labelled_sample, sigmoid
from loggraph.llm.quality import keep_good, pieces, score_quality, spread_pieces, train_quality
from loggraph.llm.toxicity import drop_toxic, find_categories, score_toxicity, train_toxicity

SF = "/root/testdata/sf0.1"


def corpus(spark, n=900):
    """Prose, junk, and prose with words of three kinds of abuse (one per language)."""
    r = random.Random(5)
    vocab = ["".join(r.choice(["an", "en", "er", "in", "on", "th", "re", "st"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    kinds = [["scum", "idiot", "moron"], ["trottelhaft", "trottelig", "deppenhaft"], ["crétine", "crétinerie", "andouille"]]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        quality, toxic = int(r.random() < 0.8), int(r.random() < 0.25)
        if toxic:
            for w in r.sample(r.choice(kinds), r.randint(1, 3)):
                words.insert(r.randrange(len(words)), w)
        text = " ".join(words) + "." if quality else r.choice(["### ", "%%% | "]).join(words)
        docs.append((i, text, "sc", 0.1, 3))
        labels.append((i, quality, toxic))
    docs += [(n, None, None, None, None), (n + 1, "", "x", 0.0, 0), (None, "no id", "x", 0.0, 0), (n + 2, vocab[0] + " " + "on the " * 40_000, "x", 0.0, 0)]
    labels += [(None, 1, 0), (n + 1, None, None), (3, 1 - labels[3][1], labels[3][2])]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string, fold double, y int").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_fit_logistic():
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((4000, 1)), rng.normal(size=(4000, 2))])
    y = (rng.random(4000) < sigmoid(x @ np.array([-1, 2, -0.5]))).astype(float)
    assert np.allclose(fit_logistic(x, y), [-1, 2, -0.5], atol=0.2)


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = train_quality(docs, labels)
    out = score_quality(docs, model)
    assert out.count() == docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = out.join(labels.where("doc_id <> 3"), "doc_id").where(held_out()).collect()
    assert len(rows) > 100 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.97
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out.where("score >= 0.3").collect()}


def long_corpus(spark, n, long_classes, fill=30_000):
    """Documents beyond 16 KiB of the classes given, short ones of the other."""
    r = random.Random(4)
    vocab = ["".join(r.choice(["an", "en", "er", "in", "on", "th", "re", "st"]) for _ in range(r.randint(1, 3))) for _ in range(400)]
    rows = []
    for i in range(n):
        y = i % 2
        words = [r.choice(vocab) for _ in range(fill // 6 if y in long_classes else r.randint(20, 120))]
        rows.append((i, (" " if y else " ### ").join(words), y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    return docs.select("doc_id", "text"), docs.select("doc_id", "quality")


@pytest.mark.parametrize("long_classes", [(0, 1), (1,)])
def test_quality_learns_from_long_documents(spark, long_classes):
    docs, labels = long_corpus(spark, 160, long_classes)
    rows = score_quality(docs, train_quality(docs, labels)).join(labels, "doc_id").where(held_out()).collect()
    assert len(rows) > 15 and all((r.score >= 0.3) == (r.quality == 1) for r in rows)


def test_pieces_spread_over_the_whole_text():
    text = "".join(f"{k:07d} " for k in range(20_000))
    some, whole = spread_pieces(text), pieces(text)
    assert len(some) == 8 and some[0] == whole[0] and some[-1] == whole[-1] and len(set(some)) == 8
    assert spread_pieces(text[:16_384]) == pieces(text[:16_384]) and spread_pieces("") == []


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    out = score_toxicity(docs, train_toxicity(docs, labels))
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where(held_out()).collect()
    assert len(rows) > 100 and all((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    assert sum(max(r.category_1, r.category_2, r.category_3) > 0.5 for r in rows if r.toxic) > 0.9 * sum(r.toxic for r in rows)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out.where("score < 0.5").collect()}


def test_categories_group_marks_that_go_together():
    rng = np.random.default_rng(2)
    kind = rng.integers(0, 3, 300)
    x = np.zeros((300, 9))
    for k in range(3):
        x[kind == k, 3 * k:3 * k + 3] = rng.random(((kind == k).sum(), 3)) < 0.7
    groups = find_categories(x, np.ones(300), 4)
    assert sorted(sorted(g.tolist()) for g in groups[:3]) == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]


@pytest.mark.parametrize("rows", [0, 6])
def test_too_few_labels(spark, rows):
    docs, labels = corpus(spark, 40)
    labels = labels.where(F.col("doc_id") < rows)
    quality = [r.score for r in score_quality(docs, train_quality(docs, labels)).collect()]
    assert len(quality) == docs.count() and len(set(quality)) == 1 and 0 < quality[0] < 1
    toxic = score_toxicity(docs, train_toxicity(docs, labels)).collect()
    assert len(toxic) == docs.count() and all(r.category_1 == 0 for r in toxic)


def test_no_documents(spark):
    docs, labels = corpus(spark, 40)
    none = docs.where("doc_id < 0")
    assert score_quality(none, train_quality(none, labels)).count() == 0
    assert score_toxicity(none, train_toxicity(none, labels)).count() == 0


def test_sample_is_full_where_documents_hold_part_of_the_labels(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = spark.range(4000).where("id % 20 < 2").select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    docs = docs.unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS doc_id, 'none' AS text"))
    sizes = {r.y: r["count"] for r in labelled_sample(docs, labels, "toxic", 100).groupBy("y").count().collect()}
    assert sizes == {0: 100, 1: 100}


def test_given_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    quality = score_quality(docs, train_quality(docs, labels)).join(labels, "doc_id").where(held_out())
    toxic = score_toxicity(docs, train_toxicity(docs, labels)).join(labels, "doc_id").where(held_out())
    assert quality.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.98
    assert toxic.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("double"))).first()[0] > 0.98


def test_toxic_words_far_beyond_a_few_hundred_are_all_caught(spark):
    """Four made-up languages, 80 toxic words each, five of them in a toxic document:
    recall and clean documents apart, and every language has a category of its own."""
    r = random.Random(11)
    letters = {"k": "bdkmra", "l": "elnoprs", "m": "fgimtu", "n": "chjvwyz"}
    word = lambda a: "".join(r.choices(letters[a], k=r.randint(6, 9)))
    clean = {a: [word(a) for _ in range(3000)] for a in letters}
    bad = {a: [word(a) + "x" for _ in range(80)] for a in letters}
    docs, labels = [], []
    for i in range(4000):
        a = r.choice(list(letters))
        toxic = int(r.random() < 0.3)
        text = r.choices(clean[a], k=60) + (r.sample(bad[a], 5) if toxic else [])
        r.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = (score_toxicity(docs, train_toxicity(docs, labels)).withColumnRenamed("doc_id", "i")
            .join(labels, F.col("i") == F.col("doc_id")).where(held_out()).collect())
    bad_rows, good_rows = [x for x in rows if x.toxic], [x for x in rows if not x.toxic]
    assert len(bad_rows) > 150
    assert sum(x.score >= 0.5 for x in bad_rows) >= 0.95 * len(bad_rows)
    assert sum(x.score < 0.5 for x in good_rows) >= 0.98 * len(good_rows)


def test_recall_on_held_out_toxic_rows(spark):
    """Of the given tables' held-out toxic rows that hold any word seen in toxic training
    rows alone; the others carry the label without a sign of it."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), 0))
    known = docs.join(labels, "doc_id").select("doc_id", "toxic", held_out().alias("held"), F.explode(words).alias("w"))
    signs = (known.where("NOT held").groupBy("w").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
             .where("n1 >= 4 AND n0 = 0").select("w"))
    signed = known.where("held AND toxic = 1").join(F.broadcast(signs), "w").select("doc_id").distinct()
    out = score_toxicity(docs, train_toxicity(docs, labels))
    caught = out.join(signed, "doc_id").select((F.col("score") >= 0.5).cast("int").alias("c")).agg(F.sum("c"), F.count("c")).first()
    assert caught[1] > 70 and caught[0] >= 0.95 * caught[1]
    clean = out.join(labels.where("toxic = 0"), "doc_id").where(held_out()).agg(F.avg((F.col("score") < 0.5).cast("double"))).first()[0]
    assert clean >= 0.99
