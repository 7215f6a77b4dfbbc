"""Byte-level BPE by merge replay, held against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loggraph.llm import merge_replay as M

PATHS = [public_tokenizers.path(f"{n}.tiktoken") for n in ("byte_bpe_50k", "byte_bpe_multi_50k")]


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in codec.encode(texts)]


@pytest.mark.parametrize("path", PATHS)
def test_odd_texts(path):
    codec, enc, r = M.MergeReplay(path, public_tokenizers.PATTERN), library(path), random.Random(3)
    letters = " \n\tab's1é中🙂　.,=\x1c\x85\xa0ñZt́ㅎ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    texts += ["", " ", "  ", "a  ", "a\n ", " a", "\n", "x" * 4000, "=" * 5001, " " * 777, "ab" * 3000, "1234567890" * 50,
              "<|endoftext|>", "don't can't we'll", "a " * 3 + " ", "\0\0"]
    assert ids(codec, texts) == [enc.encode_ordinary(t) for t in texts]
    for t in texts:
        assert codec.decode(enc.encode_ordinary(t)) == t.encode()


CODEC, LIBRARY = M.MergeReplay(PATHS[0], public_tokenizers.PATTERN), library(PATHS[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_any_texts(texts):
    assert ids(CODEC, texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_long_words_and_words_merged_alone_agree():
    r = random.Random(4)
    words = [bytes(r.choices(b"theriaonsnglm", k=r.randint(1, 60))) for _ in range(3000)]
    assert CODEC.replay(words) == [CODEC._alone(w) for w in words]


def test_known_words_are_bounded_and_move_on(monkeypatch):
    monkeypatch.setattr(M, "KEPT_WORDS", 20)
    codec = M.MergeReplay(PATHS[0], public_tokenizers.PATTERN)
    for k in range(30):
        text = " ".join(f"word{k + j} same" for j in range(9))
        assert ids(codec, [text]) == [LIBRARY.encode_ordinary(text)]
        assert len(codec.known) <= 20 + 19 and len(codec.older) <= 20 + 19


@pytest.mark.parametrize("block_chars", [1, 50, 4 << 20])
def test_rows(spark, block_chars):
    rows = [(1, "Hello there, there", "x"), (1, "Hello there, there", "y"), (None, "né  é", "z"), (3, None, None), (4, "", ""),
            (5, "word " * 20_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = M.encode_decode(docs, PATHS[0], public_tokenizers.PATTERN, block_chars=block_chars).collect()
    assert sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in out) == sorted(
        (i or 0, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert M.encode_decode(docs.limit(0), PATHS[0], public_tokenizers.PATTERN).count() == 0


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {}
    for d in docs:
        found = LIBRARY.encode_ordinary(d.text or "")
        want[d.doc_id] = (len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(),
                          hashlib.sha256((d.text or "").encode()).hexdigest())
    got = M.op11_merge_replay(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(docs)
