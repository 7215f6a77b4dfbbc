"""Operators 5, 6 and 9 against the libraries called directly."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loggraph.llm.byte_bpe import ByteBpe
from loggraph.llm.packing import pack, pieces_of
from loggraph.llm.sentencepiece_codec import PieceBpe, decode_documents, encode_and_decode, encode_documents
from loggraph.llm.token_store import read_tokens, write_tokens

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", " \n", "\x85", "\x1c", "\xa0", "a", "the", "é", "😀", "ﬁ", "한", "्", "²", "ª", "'s", "'ll",
         "<|endoftext|>", "</s>", "<0x41>", ".", "12", "\x00", "▁", "　", "x" * 40, "�"]
TEXTS = [None, "", " ", "one", "<|endoftext|> x", "a" * 5000, "  two   spaces \n \n b", "word " * 3000, "one", "é\tü 中文"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, "repeated id", "y", 2), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, shard int").repartition(3)


def library_ids(text):
    return Tokenizer.from_file(BYTE).encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_byte_bpe_equals_the_library():
    tok, own = Tokenizer.from_file(BYTE), ByteBpe(BYTE, kept_words=50)
    assert own.by_word
    for t in [t or "" for t in TEXTS] + random_texts(4000, 1):
        assert np.frombuffer(own.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_blocks_equal_the_library():
    tok, own, r = Tokenizer.from_file(BYTE), ByteBpe(BYTE, kept_words=50), random.Random(6)
    texts = [t or "" for t in TEXTS] + random_texts(4000, 5) + ["слово за словом", "a b\n c  d", "été à l'île", " \n", "\n x", "x \n"]
    r.shuffle(texts)
    want = {t: tok.encode(t, add_special_tokens=False).ids for t in texts}
    at = 0
    while at < len(texts):
        some = texts[at:at + r.choice([1, 2, 30, 900])]
        got = own.many(pa.array(some, pa.string()))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [want[t] for t in some]
        at += len(some)
    assert own.many(pa.array([], pa.string())) == []
    assert own.many(pa.array(texts)[-20:]) == [own.ids(t) for t in texts[-20:]]


def test_a_block_asks_the_library_once_for_a_word():
    own, asked = ByteBpe(BYTE, kept_words=1), []
    ask = own.ask
    own.ask = lambda letters: asked.append(letters) or ask(letters)
    texts = [f"same words again, word{chr(97 + k % 3)}\nof été" for k in range(200)]
    ids = own.many(pa.array(texts))
    assert len(asked) == len(set(asked)) and [own._whole(t) for t in texts] == ids


def test_piece_bpe_equals_the_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), PieceBpe(PIECE, kept_words=50)
    pieces = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    r = random.Random(3)
    mixed = ["".join(r.choice(pieces) for _ in range(r.randint(1, 6))) for _ in range(4000)]
    for t in [t or "" for t in TEXTS] + random_texts(4000, 2) + mixed + [" " * n + "a" + " " * (n // 2) for n in range(70)]:
        ids = lib.encode(t)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, repr(t)
        assert own.decode(ids) == lib.decode(ids)
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_pair_test_equals_direct_merging():
    own, r = PieceBpe(PIECE), random.Random(4)
    ids = [i for i in own.text_of if own.text_of[i] not in own.runs and (i in own.parts or len(own.text_of[i]) == 1)]
    for _ in range(20000):
        a, b = r.choice(ids), r.choice(ids)
        if "▁" in own.text_of[b]:
            continue
        texts = list(own.text_of[a] + own.text_of[b])
        assert own._compatible((a, b)) == (own._merge([own.piece[c] for c in texts], texts) == [a, b])


def test_token_store_round_trip(spark, docs, tmp_path):
    name = write_tokens(docs, f"{tmp_path}/store", BYTE)
    rows = read_tokens(spark, f"{tmp_path}/store").collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    want = sorted((r.doc_id is not None, r.doc_id or 0, library_ids(r.text)) for r in docs.collect())
    assert got == want
    order = [(r.shard, r.block, r.place, -1 if r.doc_id is None else r.doc_id) for r in rows]
    assert [x[3] for x in sorted(order)] == sorted(x[3] for x in order)
    one = read_tokens(spark, f"{tmp_path}/store", 7).collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in one] == [library_ids(TEXTS[7])]
    assert {r.dict_hash for r in spark.read.parquet(f"{tmp_path}/store/blocks").collect()} == {name}


def test_token_store_with_dictionary_and_wrong_dictionary(spark, tmp_path):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('some short text number ', id, ' of a small set') AS text")
    path = f"{tmp_path}/store"
    name = write_tokens(docs, path, BYTE)
    assert name != hashlib.sha256(b"").hexdigest()
    assert read_tokens(spark, path).where("n_tokens < 2").count() == 0
    spark.createDataFrame([(name, bytearray(b"other"))], "dict_hash string, dictionary binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="not the one"):
        read_tokens(spark, path).collect()


def test_store_query_starts(spark, docs, tmp_path):
    from loggraph.llm.token_store import op5_token_store
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(op5_token_store(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id is not None and r.doc_id for r in rows] == [False, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9]
    by_id = {r.doc_id: r.ids_crc32 for r in rows}
    assert all(by_id[i] == crc(library_ids(t)) for i, t in enumerate(TEXTS) if i != 3)


def test_empty_tables(spark, docs, tmp_path):
    none = docs.where("doc_id < -1")
    write_tokens(none, f"{tmp_path}/store", BYTE)
    assert read_tokens(spark, f"{tmp_path}/store").count() == 0
    assert pack(none, BYTE).count() == 0
    assert decode_documents(encode_documents(none, PIECE), PIECE).count() == 0


@pytest.mark.parametrize("limit", [1, 8, 1024])
def test_pieces_cover_a_document_once(limit):
    for n in [1, 2, 7, 8, 9, 1023, 1024, 1025, 5000]:
        pieces, at = pieces_of(n, limit), 0
        for start, length in pieces:
            assert start == at and length <= limit and length & (length - 1) == 0
            at += length
        assert at == n and len(pieces) <= n // limit + 11


def test_packing(spark, docs):
    rows = pack(docs, BYTE).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        mine = sorted((r.start, r.length, r.ids, r.doc_tokens) for r in rows if r.doc_id == i)
        ids = np.concatenate([np.frombuffer(m[2], "<u4") for m in mine]).tolist()
        assert ids == library_ids(t) and mine[0][3] == len(ids)
        assert all(len(m[2]) == 4 * m[1] for m in mine)


def test_sentencepiece_documents(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = decode_documents(encode_documents(docs, PIECE), PIECE).collect()
    assert sorted(rows, key=str) == sorted(encode_and_decode(docs, PIECE).collect(), key=str)
    got = sorted((np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.text) for r in rows)
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((ids, len(ids), lib.decode(ids)))
    assert got == sorted(want)


def test_long_documents_alone_train_a_dictionary(spark, tmp_path):
    import random

    from loggraph.llm import token_store
    r = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=4000))) for i in range(20)], "doc_id long, text string")
    path = str(tmp_path / "store")
    name = token_store.write_tokens(docs, path, BYTE)
    assert len(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]) > 0
    assert name != __import__("hashlib").sha256(b"").hexdigest()
    assert token_store.read_tokens(spark, path).count() == 20


def test_pieces_cover_a_long_array_evenly():
    from loggraph.llm.token_store import pieces
    ids = bytes(range(200)) * 4
    assert b"".join(pieces(ids, 10, 1000)) == ids
    some = pieces(ids, 10, 5)
    assert len(some) == 5 and some[0] == ids[:40] and some[-1] == ids[-40:]
