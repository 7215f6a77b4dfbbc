"""Operators 1, 2 and 8 against plain Python."""

import random

import numpy as np
import pytest

from loggraph.llm import ngram_join as nj
from loggraph.llm.components import connected_components
from loggraph.llm.exact_dedup import drop_copies, exact_dedup
from loggraph.llm.line_dedup import line_dedup

from .plain import exact_copies, line_drops, near_classes, sha, shingles

COLUMNS = "doc_id long, text string, sha string, row string, kept string, n_lines int, gone_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", None, "k", 7, 1) for i, t in rows], COLUMNS).repartition(5)


def copies():
    base = ["", None, " ", "a  b", "a\tb", "a b", "A b", "é x", "é\n\nx", "a\xa0b", "long " * 4000, "hot"]
    rows = [(i, t) for i, t in enumerate(base)]
    return rows + [(100 + i, "hot") for i in range(60)] + [(200 + i, f"text {i // 2}") for i in range(30)]


@pytest.mark.parametrize("bits", [{}, {"bits_per_row": 1, "max_filter_bits": 64}])
def test_exact_dedup(spark, bits):
    rows = copies()
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256, r.kept) for r in exact_dedup(frame(spark, rows), **bits).collect()}
    want = exact_copies(rows)
    assert got == {i: (k, n, s, i == k) for i, (k, n, s) in want.items()}
    left = drop_copies(frame(spark, rows), **bits)
    assert left.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, w in want.items() if w[0] == i)


def test_exact_dedup_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(None, "x"), (3, "x"), (3, "x"), (None, "y"), (None, "y")]
    out = exact_dedup(frame(spark, rows)).collect()
    assert sorted((r.text_sha256, r.kept) for r in out) == sorted(
        [(sha("x"), True), (sha("x"), False), (sha("x"), False), (sha("y"), True), (sha("y"), False)])
    assert {r.keep_id for r in out if r.text_sha256 == sha("x")} == {3}
    assert sorted(r.text for r in drop_copies(frame(spark, rows)).collect()) == ["x", "y"]
    none = frame(spark, rows).where("doc_id > 9")
    assert exact_dedup(none).count() == 0 and drop_copies(none).count() == 0


def test_line_dedup(spark):
    r = random.Random(2)
    lines = ["", " ", "short", "A common line here", "  a COMMON line here\t", "É accented LINE", "é accented line",
             "0123456789", "012345678", "same line inside\r"]
    rows = [(i, "\n".join(r.choice(lines + [f"own line number {i}"]) for _ in range(r.randint(1, 9)))) for i in range(60)]
    rows += [(61, None), (62, ""), (63, "\n"), (64, "line\n" * 3000), (65, "A common line here")]
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.kept_text) for x in line_dedup(frame(spark, rows)).collect()}
    assert got == line_drops(rows)
    assert line_dedup(frame(spark, rows).where("doc_id > 99")).count() == 0
    odd = [(None, "a line of its own"), (5, "a line of its own"), (5, "another line here"), (7, "another line here")]
    got = sorted((x.doc_id or 0, x.kept_text) for x in line_dedup(frame(spark, odd)).collect())
    assert got == [(0, ""), (5, "a line of its own"), (5, "another line here"), (7, "")]


def near_rows(seed, n, size):
    """Families of texts with growing numbers of edits, a passage many texts share,
    copies, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(r.randint(4, size))]
        if r.random() < 0.5:
            base[2:2] = passage
        for _ in range(r.choice([1, 1, 2, 25])):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                text[r.randrange(len(text))] = word()
            rows.append((len(rows), (" " if r.random() < 0.9 else "\t").join(text).replace("a", r.choice("aA"))))
    short = [None, "", " \n", "one", "One", "one two", "one  two", "a b c", "a b c d", "a b c d e", "É b c", "é b c"]
    return rows + [(len(rows) + i, t) for i, t in enumerate(short)]


@pytest.mark.parametrize("words,percent,size", [(4, 85, 90), (5, 80, 40), (2, 50, 20)])
def test_ngram_join(spark, words, percent, size):
    rows = near_rows(words, 260, size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(frame(spark, rows), words, percent).collect()}
    want = near_classes(rows, words, percent)
    assert got == want
    assert any(c != i for i, (_, c) in want.items())


def test_ngram_join_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "MEET", 7)
    monkeypatch.setattr(nj, "BLOCK_ROWS", 5)
    rows = near_rows(8, 150, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(frame(spark, rows), 4, 85).collect()}
    assert got == near_classes(rows, 4, 85)
    left = nj.drop_near_copies(frame(spark, rows), 4, 85)
    assert left.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in got.items() if c == i)


def test_ngram_join_odd_ids_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other words stand in this one"), (9, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in nj.ngram_join(frame(spark, rows), 4, 85).collect())
    assert got == [(0, 3, 4), (4, 3, 4), (4, 3, 4), (4, 3, 4), (9, 0, 9)]
    assert nj.ngram_join(frame(spark, rows).where("doc_id > 99"), 4, 85).count() == 0


def test_drop_near_copies_goes_by_row(spark):
    base = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join(base[:-k] + [f"x{k}"] * k)
    alone = "a clean text of its own that nothing else resembles"
    # id 5 on a near copy and on a text of its own; null ids near an id, near each other, and alone
    rows = [(1, near(1)), (5, near(2)), (5, alone), (None, near(3)), (None, "z " + alone.upper()[::-1]), (5, None), (None, "")]
    rows += [(None, " ".join(f"v{k}" for k in range(50))), (None, " ".join(f"v{k}" for k in range(49)) + " u")]
    rows += [(8, "rows that stand here twice or more")] * 3 + [(9, "rows that stand here twice or more")]
    left = nj.drop_near_copies(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in left.collect()))
    families = [t for i, t in got if t.startswith("v0 ")]
    assert len(families) == 1 and families[0] in (rows[7][1], rows[8][1])
    assert [x for x in got if not x[1].startswith("v0 ")] == sorted(
        [(1, near(1)), (5, alone), (5, ""), (0, ""), (0, rows[4][1]), (8, "rows that stand here twice or more")])
    many = [(None, " ".join(f"{k}n{j}" for j in range(30))) for k in range(40)] + [(None, " ".join(f"{k}n{j}" for j in range(29))) for k in range(40)]
    assert nj.drop_near_copies(frame(spark, many)).count() == 40


@pytest.mark.parametrize("meet,block_rows", [(2048, 1024), (7, 5)])
def test_ngram_join_counts_every_link(spark, monkeypatch, meet, block_rows):
    monkeypatch.setattr(nj, "MEET", meet)
    monkeypatch.setattr(nj, "BLOCK_ROWS", block_rows)
    rows = near_rows(8, 150, 60)
    rows += [(1000 + i, t) for i, t in rows[::3]]  # copies
    sets = {i: shingles(t, 4) for i, t in rows}
    near = lambda a, b: 100 * len(a & b) >= 85 * len(a | b) and len(a & b) > 0
    want = {i: sum(near(s, t) for j, t in sets.items() if i != j) for i, s in sets.items()}
    got = {r.doc_id: r.n_links for r in nj.ngram_join(frame(spark, rows), 4, 85).collect()}
    assert got == want and max(want.values()) > 20


def test_sketch_bound_and_large_forests():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:300 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(0, 120)]
    sets += [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 130, 260, 600, 5000)]
    for a in sets[::7]:
        for b in sets[::5]:
            x, y = (int.from_bytes(nj.odd_sketch(s), "little") for s in (a, b))
            m, k = nj.sketch_bits(len(a)), nj.sketch_bits(len(b))
            if m != k:
                continue
            assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))
    ids = list(range(len(sets)))
    parts = []
    for some in (ids, ids[::3]):  # the array path and the integer path
        tree = nj.Forest(len(ids))
        for a, b in nj.forest(some, [len(sets[i]) for i in some], [nj.odd_sketch(sets[i]) for i in some], 85):
            tree.join(a, b)
        parts.append([tree.root(i) for i in ids])
        for i in some:
            for j in some:
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    assert tree.root(i) == tree.root(j)


def test_connected_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [
        (r.randrange(300, 420), r.randrange(300, 420)) for _ in range(60)] + [(7, 7)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = list(range(500))
    for a, b in edges * 60:
        up[a] = up[b] = min(up[a], up[b])
    assert got == {n: up[n] for e in edges if e[0] != e[1] for n in e}
