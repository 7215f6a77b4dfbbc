"""Operator 10: the law, whole groups, gapless slots."""

import zlib

import numpy as np
import pytest

from loggraph.llm.sharding import HEAVY, place, shard_documents


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"text {i} " * (1 + i % 37)) for i in range(3000)]
    out += [(5000 + i, "hot text " * 20) for i in range(1500)]
    out += [(7000 + i, f"pair {i // 2}") for i in range(600)]
    return out + [(9000, None), (9001, ""), (9001, ""), (None, "no id"), (9002, "long " * 20_000)]


def sharded(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "s", 1, "i") for i, t in rows], "doc_id long, text string, shard string, slot int, item string")
    return shard_documents(docs.repartition(5), **more).collect()


@pytest.mark.parametrize("n_shards", [1, 5, 24])
def test_shards(spark, rows, n_shards):
    out = sharded(spark, rows, n_shards=n_shards, rows_per_slice=20)
    key = lambda i, t: (i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted(key(i, t) for i, t in rows)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(n_shards))
    for mine in shards.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    sizes = np.array([sum(r.size for r in shards.get(s, [])) for s in range(n_shards)])
    heaviest = max(r.size for r in out)
    assert sizes.max() - sizes.min() <= max(0.1 * sizes.mean(), heaviest)
    by_text = {}
    for r in out:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    text = {zlib.crc32((t or "").encode()): t for _, t in rows}
    assert all(len(s) == 1 for c, s in by_text.items() if (text[c] or "").startswith("pair"))


def test_no_rows(spark, rows):
    assert sharded(spark, []) == []


def test_place_balances_all_dimensions():
    rng = np.random.default_rng(4)
    items = rng.random((2000, 3)) ** 3
    items /= items.sum(axis=0)
    where = place(items, 24)
    loads = np.stack([np.bincount(where, items[:, k], 24) for k in range(3)])
    assert (np.abs(loads * 24 - 1) < 0.05).all()
    assert HEAVY >= 8
