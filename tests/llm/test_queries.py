"""Registered queries of the subpackage, their SQL, and the pipeline."""

import os
import sys

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from loggraph.llm.queries import ORACLE, QUERIES  # noqa: E402

from .plain import BLANKS, near_classes  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= names
    assert set(ORACLE) <= set(entry.oracle_sql())
    assert [len(corpus_pipeline.STAGES), "pipeline" in entry.oracle_sql()] == [5, False]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF).select(*columns).collect()
    rows = want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    tidy = lambda rs: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs)
    assert tidy(got) == tidy(rows)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables with enough labels
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    left = docs
    for name in ("quality", "toxicity"):
        before, left = left, stage[name](spark, left, sf).cache()
        assert left.columns == docs.columns
        column = {"quality": ("quality", 1), "toxicity": ("toxic", 0)}[name]
        known = [(r.doc_id, getattr(labels[r.doc_id], column[0]) == column[1]) for r in before.collect() if r.doc_id in labels]
        kept = {r.doc_id for r in left.collect()}
        assert sum(clean == (i in kept) for i, clean in known) >= 0.9 * len(known)
    rows = [(r.doc_id, r.text) for r in left.collect()]
    left = stage["exact_dedup"](spark, left, sf).cache()
    first = {}
    for i, t in sorted(rows):
        first.setdefault(BLANKS.sub(" ", t or ""), i)
    assert sorted(r.doc_id for r in left.collect()) == sorted(first.values())
    rows = [(r.doc_id, r.text) for r in left.collect()]
    left = stage["near_copies"](spark, left, sf).cache()
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in near_classes(rows, 5, 80).items() if c == i)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in left.collect()}
    got = {}
    for r in stage["packing"](spark, left, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_pipeline_stages_bound_their_batches(spark, tmp_path):
    import pyarrow as pa

    from loggraph.session import BATCH_KEY

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"])

    def largest():
        return max(r.bytes for r in docs.mapInArrow(measured, "bytes long").collect())

    text = "concat_ws(' ', transform(sequence(1, 400), k -> hex(xxhash64(id, k))))"
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", f"{text} AS text")  # 13 MB in one partition
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.getAll.get(BATCH_KEY)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(BATCH_KEY)
            assert largest() > 12 << 20
            stage(spark, docs.limit(20), str(tmp_path))
            assert largest() < 5 << 20, name
        spark.conf.set(BATCH_KEY, "1m")  # a bound of the session's own stays
        corpus_pipeline.stage_exact_dedup(spark, docs.limit(20), str(tmp_path))
        assert largest() < 2 << 20
    finally:
        spark.conf.unset(BATCH_KEY) if before is None else spark.conf.set(BATCH_KEY, before)
