"""Conversation repair, held against a search over all edits."""

import hashlib
import random
import re

import pytest

from loggraph.llm import conversation_repair as C

VIABLE = re.compile(r"s?(ua)*u?")
WHOLE = re.compile(r"(s?(ua)+)?")


def best(rows):
    """(cost, audit, repaired) by trying every edit. rows: (role, text, fault)."""
    found = []

    def go(k, cost, audit, out, gap):
        initials = "".join(r[:1] for r, _ in out)
        if not VIABLE.fullmatch(initials) or cost > 3 * len(rows):
            return
        if k == len(rows) and WHOLE.fullmatch(initials):
            found.append((cost, audit, out))
        if gap < 2:
            for x in ("user", "assistant"):
                go(k, cost + 2, audit + "I", [*out, (x, "")], gap + 1)
        if k == len(rows):
            return
        role, text, fault = rows[k]
        go(k + 1, cost + 3, audit + "D", out, 0)
        if fault not in ("b", "d"):
            more = fault == "t"
            if role[:1] in ("s", "u", "a"):
                go(k + 1, cost + more, audit + "K", [*out, (role, text)], 0)
            for x in ("user", "assistant"):
                go(k + 1, cost + 2 + more, audit + "R", [*out, (x, text)], 0)

    go(0, 0, "", [], 0)
    return min(found, key=lambda f: f[:2])


def plain(rows):
    """The whole result of rows (turn, role, text) in order."""
    seen, faulty = set(), []
    for _, role, text in rows:
        held = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not held else "d" if (role, text) in seen else "" if held[-1] in ".!?" else "t"
        seen.add((role, text))
        faulty.append((role, text, fault))
    pairs = [a[:1] + b[:1] for (_, a, _), (_, b, _) in zip(rows, rows[1:])]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = best(faulty)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(f == x for _, _, f in faulty) for x in "bdt"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()), out


def made(seed, n, longest):
    r = random.Random(seed)
    rows = {}
    for c in range(n):
        turns = sorted(r.choices([None, *range(9)], k=r.randint(1, longest)), key=lambda t: (t is not None, t))
        mine = [(t, r.choice(["user", "assistant", "system", "tool", " "]), r.choice(["Yes.", "No", "Go on!", " \n", "x? ", "", "Well."]))
                for t in turns]
        rows[c] = sorted(mine, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    return rows


def frame(spark, rows):
    flat = [(c, *r, 7) for c, mine in rows.items() for r in mine]
    random.Random(1).shuffle(flat)
    return spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, audit long")


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("bounds", [{}, {"whole_rows": 2}, {"whole_chars": 12}, {"whole_rows": 0}])
def test_equals_all_edits(spark, bounds):
    rows = made(5, 40, 5)
    want = {c: plain(mine) for c, mine in rows.items()}
    out = C.repair(frame(spark, rows), **bounds)
    got = out.report.collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == {c: w[0] for c, w in want.items()}
    assert len(got) == len(rows)
    turns = {}
    for r in sorted(out.turns.collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: w[1] for c, w in want.items() if w[1]}


def test_one_task_and_stretches_agree_on_a_long_conversation(spark):
    rows = {0: made(8, 1, 5)[0] * 60, 1: made(9, 1, 3)[0], None: made(10, 1, 4)[0] * 30}
    df = frame(spark, rows)
    a, b = C.repair(df).report.collect(), C.repair(df, whole_rows=10).report.collect()
    assert sorted(map(str, a)) == sorted(str(r) for r in b) and len(a) == 3


def test_stretches_compose_to_the_whole():
    r = random.Random(2)
    for _ in range(200):
        rows = [C.Row(r.choice(["s", "u", "a", ""]), r.choice(["", "", "t", "b", "d"]), r.choice([1, 1, 2])) for _ in range(r.randint(1, 12))]
        tops, backs = C.entry(C.NOTHING), []
        for row in rows:
            tops, back = C.shift(tops, row)
            backs.append(back)
        cost, state = C.accept(tops)
        cut = sorted(r.sample(range(len(rows) + 1), min(2, len(rows))))
        parts = [p for p in (rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])) if p]
        stretches = []
        for p in parts:
            flat = []
            for s in C.STATES:
                t = C.entry(s)
                for row in p:
                    t, _ = C.shift(t, row)
                flat += t
            stretches.append({"costs": [t and t[0] for t in flat], "ranks": [t and t[1] for t in flat]})
        ways, lacks, total = C.compose(stretches)
        assert (total, lacks) == (cost, C.LACKS[state])
        audits = []
        for p, (enter, leave) in zip(parts, ways):
            t, back = C.entry(enter), []
            for row in p:
                t, x = C.shift(t, row)
                back.append(x)
            edits, start = C.walk_back(back, leave)
            assert start == enter
            audits += [e[0] for e in edits]
        assert audits == [e[0] for e in C.walk_back(backs, state)[0]]


def test_copies_nulls_and_empty_tables(spark):
    empty_hash = hashlib.sha256(b"").hexdigest()
    rows = [(1, 0, "user", "Hi.", 2), (1, 1, "assistant", "Yes.", 1), (2, 0, "user", "gone", 0), (3, None, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    for bounds in ({}, {"whole_rows": 0}):
        out = {r.conv_id: tuple(r[c] for c in COLUMNS[:7]) for r in C.repair(df, **bounds).report.collect()}
        assert out == {1: (0, 0, 1, 0, 1, 3, "KDK"), 2: (0, 0, 0, 0, 0, 0, ""), 3: (0, 1, 0, 0, 0, 3, "D")}
        assert {r.repaired_sha256 for r in C.repair(df, **bounds).report.where("conv_id > 1").collect()} == {empty_hash}
        assert C.repair(df.limit(0), **bounds).report.count() == 0
