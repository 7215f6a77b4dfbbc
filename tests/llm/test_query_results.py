"""Registered queries without SQL, held against the libraries and the contract's words."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loggraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: np.asarray([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for i, t in docs.items()}


def test_op5_reads_the_ids_back(spark, ids):
    rows = QUERIES["op5_token_store"](spark, SF).collect()
    start, want = 0, []
    for i in sorted(ids):
        want.append((i, start, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        start += len(ids[i])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_op6_pieces_and_sequences(spark, ids):
    rows = QUERIES["op6_packing"](spark, SF).collect()
    of_doc, of_sequence = {}, {}
    for r in rows:
        of_doc.setdefault(r.doc_id, []).append(r)
        of_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    assert of_doc.keys() == ids.keys()
    for i, pieces in of_doc.items():
        pieces.sort(key=lambda r: r.start)
        ends = np.cumsum([p.length for p in pieces]).tolist()
        assert [p.start for p in pieces] == [0, *ends[:-1]] and ends[-1] == len(ids[i])
    assert sorted(of_sequence) == list(range(len(of_sequence)))
    for pieces in of_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([p.length for p in pieces]).tolist()
        assert [p.offset for p in pieces] == [0, *ends[:-1]] and ends[-1] <= 1024
        # padded only where the length is no power of two
        assert ends[-1] & (ends[-1] - 1) == 0


def test_op9_equals_the_library(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = QUERIES["op9_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        found = model.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(found)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(found, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(found).encode()).hexdigest()


def test_op10_law_of_bytes(spark, docs):
    rows = QUERIES["op10_sharding"](spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    shards, group = {}, {}
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        shards.setdefault(r.shard, []).append(r)
        group.setdefault(raw, set()).add(r.shard)
    assert set(shards) == set(range(24))
    for mine in shards.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    sizes = [sum(r.size for r in mine) for mine in shards.values()]
    largest = max(len(t.encode()) + 8 for t in docs.values())
    assert max(sizes) - min(sizes) <= max(largest, 0.15 * sum(sizes) / 24)
    assert sum(len(s) > 1 for s in group.values()) <= 3 * 24 * 16


@pytest.mark.parametrize("name", ["op4_quality", "op7_toxicity"])
def test_classifier_columns(spark, docs, name):
    rows = QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    label = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    if name == "op4_quality":
        assert all(r.predicted == (r.score >= 0.3) for r in rows)
        good = [r for r in held if label[r.doc_id].quality == 1]
        bad = [r for r in held if label[r.doc_id].quality == 0]
        assert sum(r.predicted for r in good) >= 0.95 * len(good) and sum(r.predicted for r in bad) <= 0.4 * len(bad)
    else:
        assert all(r.toxic == (r.score >= 0.5) for r in rows)
        clean = [r for r in held if label[r.doc_id].toxic == 0]
        assert sum(r.toxic for r in clean) <= 0.05 * len(clean)


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, columns with names of the
    operators' own, no labels; then no rows at all."""
    import corpus_pipeline

    fields = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, sha string, set_id long"
    rows = [(1, "the same words in this one text here", "en", "a", 3, "r", 1, "s", 1), (2, "the  same words in this one text here", None, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None), (3, "", "x", "y", 0, "z", 0, "", 0), (None, "the same words in this one text here", "en", "b", 1, "q", 2, "t", 2),
            (4, "a text that has nothing at all in common with any other", "en", "c", 5, "r", 4, "s", 4)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, fields)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), fields)
        left = {(r.doc_id, r.text) for r in docs.collect()}
        if table:
            assert (4, rows[5][1]) in left and sum("same words" in (t or "") for _, t in left) == 1
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == {i for i, _ in left}
