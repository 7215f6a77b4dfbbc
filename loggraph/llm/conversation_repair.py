"""Operator 12: repair of a conversation's structure by generalised LR parsing.

The roles of a conversation must read ``(s?(ua)+)?`` by their initials. The parser keeps a
graph-structured stack whose tops are the four states of that grammar (nothing yet, after
system, after user, after assistant). Every row shifts each top along its weighted actions:
keep it (0), give it the other role (2), delete it (3), each with the insertions (2 apiece)
that make room for it. Equal tops are merged by the least (cost, audit), audits in ASCII
order. Blank rows and copies are always deleted; a truncated row that stays adds 1.

Audits are not compared as strings: of all rows read so far every top has one action per
row, so two audits differ first at some row, and an order among the tops (their ranks)
decides. A node of the stack is therefore four (cost, rank, way back) entries whatever the
length, and a stretch of rows is a function from four entry tops to four exit tops.

A conversation of at most ``whole_rows`` rows and ``whole_chars`` of text is parsed in one
task. A longer one is cut into stretches by its order: every stretch is parsed from all
four entries at once, the small functions are composed in order, and each stretch is
walked back between its own entry and exit. So no task holds a whole long conversation;
only its hash, which has to read the repaired text in order, runs through one task as a
stream. Both ways give the same rows.

Defined cases: null role or text is one space; null turns come first; rows of one turn
stand in order of role and text; null ids are one conversation; a role that starts with
none of s, u, a can only be given another role or be deleted; a conversation without rows
has zero counts and an empty audit; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

BLANK = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
USER, ASSISTANT = "user", "assistant"
NAMES = {"u": USER, "a": ASSISTANT}
#: The grammar: state -> {initial: next state}; and the state an insertion leads to.
NOTHING, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
SHIFT = {NOTHING: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
INSERTED = {p: next((x, q) for x, q in SHIFT[p].items() if x in NAMES) for p in STATES}
#: What a conversation that ends in a state still lacks.
LACKS = {NOTHING: "", AFTER_S: "ua", AFTER_U: "a", AFTER_A: ""}
OUT_BYTES = 4 << 20
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _actions(initial: str, truncated: bool) -> list[tuple[int, int, int, str, tuple]]:
    """(from, to, cost, audit, roles) of a row that may stay: the cheapest per two states.
    ``roles`` are those of the rows it leaves, None for its own role."""
    best: dict = {}
    for start in STATES:
        options = [(3, "D", start, ())]
        state, inserts = start, ()
        for _ in range(3):
            cost, audit = 2 * len(inserts) + truncated, "I" * len(inserts)
            if initial in SHIFT[state]:
                options.append((cost, audit + "K", SHIFT[state][initial], (*inserts, None)))
            for x, to in SHIFT[state].items():
                if x in NAMES and x != initial:
                    options.append((cost + 2, audit + "R", to, (*inserts, NAMES[x])))
            x, state = INSERTED[state]
            inserts = (*inserts, NAMES[x])
        for cost, audit, to, roles in options:
            best[start, to] = min(best.get((start, to), (cost, audit, roles)), (cost, audit, roles), key=lambda o: o[:2])
    return [(p, q, *o) for (p, q), o in best.items()]


ACTIONS = {(x, t): _actions(x, t) for x in ("s", "u", "a", "") for t in (False, True)}


@dataclass(slots=True)
class Row:
    """What the parser needs of a row: its initial, its fault ('', b, d or t), its copies."""
    initial: str
    fault: str
    copies: int = 1


def shift(tops: list, row: Row) -> tuple[list, list]:
    """The tops (cost, rank) behind a row, and per top the way back (from, audit, roles)."""
    if row.fault in ("b", "d"):
        return ([t and (t[0] + 3 * row.copies, t[1]) for t in tops],
                [t and (p, "D" * row.copies, ()) for p, t in enumerate(tops)])
    best: list = [None] * 4
    for p, q, cost, audit, roles in ACTIONS[row.initial, row.fault == "t"]:
        if tops[p] is not None:
            o = (tops[p][0] + cost, tops[p][1], audit, p, roles)
            if best[q] is None or o[:3] < best[q][:3]:
                best[q] = o
    order = {q: r for r, q in enumerate(sorted((q for q in STATES if best[q]), key=lambda q: best[q][1:3]))}
    out = [o and (o[0], order[q]) for q, o in enumerate(best)]
    back = [o and (o[3], o[2], o[4]) for o in best]
    if row.copies > 1:  # the others are copies of this one
        more = "D" * (row.copies - 1)
        out = [t and (t[0] + 3 * (row.copies - 1), t[1]) for t in out]
        back = [b and (b[0], b[1] + more, b[2]) for b in back]
    return out, back


def accept(tops: list) -> tuple[int, int]:
    """(cost, state) of the best conversation that may end here."""
    return min((t[0] + 2 * len(LACKS[q]), t[1], q) for q, t in enumerate(tops) if t)[::2]


def walk_back(backs: list, state: int) -> tuple[list[tuple[str, tuple]], int]:
    """Per row (audit, roles), in order, of the way that ends in ``state``; and its start."""
    out = []
    for back in reversed(backs):
        state, audit, roles = back[state]
        out.append((audit, roles))
    return out[::-1], state


def entry(state: int) -> list:
    return [(0, 0) if p == state else None for p in STATES]


def fault_of(text: str, seen: bool) -> str:
    held = text.strip(BLANK)
    return "b" if not held else "d" if seen else "" if held.endswith(ENDS) else "t"


def initial_of(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


# --- one task per conversation ------------------------------------------------------------

REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
WHOLE = f"{REPORT}, roles array<string>, texts array<string>"
KINDS = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.string())] * 2


def repaired_whole(rows: list[tuple]) -> tuple:
    """The result of one conversation from its rows (turn, role, text, copies) in order."""
    seen, parsed, turns, counts = set(), [], [], dict.fromkeys("bdt", 0)
    for turn, role, text, copies in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        parsed.append(Row(initial_of(role), fault, copies))
        if fault:
            counts[fault] += copies if fault in "bd" else 1
        if fault not in ("b", "d"):
            counts["d"] += copies - 1
        if turn is not None:
            turns.append(turn)
    initials = [r.initial for r in parsed]
    illegal = (sum(r.copies - 1 for r in parsed) + sum(p not in LEGAL for p in zip(initials, initials[1:])))
    tops, backs = entry(NOTHING), []
    for row in parsed:
        tops, back = shift(tops, row)
        backs.append(back)
    cost, state = accept(tops)
    edits, _ = walk_back(backs, state)
    roles, texts = [], []
    for (_, made), (_, role, text, _) in zip(edits, rows):
        for r in made[:-1]:
            roles.append(r)
            texts.append("")
        if made:
            roles.append(made[-1] or role)
            texts.append(text)
    for x in LACKS[state]:
        roles.append(NAMES[x])
        texts.append("")
    audit = "".join([a for a, _ in edits]) + "I" * len(LACKS[state])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join([f"{r}:{t}" for r, t in zip(roles, texts)])
    return (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), roles, texts)


def _groups(batches, keys: int, held_if: int | None = None):
    """(key, rows) of consecutive rows with the same first ``keys`` columns, as a stream;
    rows whose column ``held_if`` is 0 only make their key known."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if key is not None:
                    yield key, held
                key, held = row[:keys], []
            if held_if is None or row[held_if]:
                held.append(row[keys:])
    if key is not None:
        yield key, held


def _whole(batches):
    names = [f.strip().split(" ")[0] for f in WHOLE.split(", ")]
    out, size = [], 0
    for (conv,), rows in _groups(batches, 1, held_if=4):
        out.append((conv, *repaired_whole(rows)))
        size += 200 + sum(map(len, out[-1][-1]))
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), KINDS)], names)


# --- conversations too long for one task --------------------------------------------------

SUMMARY = ("conv_id long, seg int, blank long, duplicate long, truncated long, illegal long, first string, last string, "
           "costs array<long>, ranks array<int>")
CHOSEN = "conv_id long, seg int, enter int, leave int, lacks string, cost long, illegal long"
EDITS = "pos long, audit string, made array<string>"
STREAMED = "conv_id long, audit string, repaired_sha256 string"


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)


def _names(fields: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in fields.split(", ")]


def _summaries(batches):
    """Each stretch as a function of its entry: costs and ranks of 4 x 4 tops."""
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def finish(key, counts, first, last, all_tops):
        flat = [t for tops in all_tops for t in tops]
        return _table([(*key, *counts, first, last, [t and t[0] for t in flat], [t and t[1] for t in flat])], kinds, _names(SUMMARY))

    key = None
    for b in batches:
        for conv, seg, _, initial, fault, copies in zip(*(c.to_pylist() for c in b.columns)):
            if (conv, seg) != key:
                if key is not None:
                    yield finish(key, counts, first, last, all_tops)
                key, counts, first, last, all_tops = (conv, seg), [0, 0, 0, 0], initial, None, [entry(p) for p in STATES]
            counts[3] += copies - 1 + (last is not None and (last, initial) not in LEGAL)
            if fault in ("b", "d"):
                counts["bd".index(fault)] += copies
            else:
                counts[1] += copies - 1
                counts[2] += fault == "t"
            last = initial
            all_tops = [shift(tops, Row(initial, fault, copies))[0] for tops in all_tops]
    if key is not None:
        yield finish(key, counts, first, last, all_tops)


def compose(stretches: list[dict]) -> list[tuple]:
    """(enter, leave) of each stretch of the cheapest whole way, what its end lacks, the cost."""
    tops, backs = entry(NOTHING), []
    for s in stretches:
        best: list = [None] * 4
        for p in STATES:
            for q in STATES if tops[p] else ():
                if s["costs"][4 * p + q] is not None:
                    o = (tops[p][0] + s["costs"][4 * p + q], tops[p][1], s["ranks"][4 * p + q], p)
                    best[q] = min(best[q] or o, o)
        order = {q: r for r, q in enumerate(sorted((q for q in STATES if best[q]), key=lambda q: best[q][1:3]))}
        tops = [o and (o[0], order[q]) for q, o in enumerate(best)]
        backs.append([o and o[3] for o in best])
    cost, state = accept(tops)
    lacks, ways = LACKS[state], []
    for back in reversed(backs):
        ways.append((back[state], state))
        state = back[state]
    return ways[::-1], lacks, cost


def _compose(table: pa.Table) -> pa.Table:
    """One conversation's stretches (at most one per range partition, 16 numbers each)."""
    stretches = sorted(table.to_pylist(), key=lambda r: r["seg"])
    ways, lacks, cost = compose(stretches)
    illegal = sum(r["illegal"] for r in stretches) + sum((a["last"], b["first"]) not in LEGAL for a, b in zip(stretches, stretches[1:]))
    rows = [(s["conv_id"], s["seg"], *way, lacks if s is stretches[-1] else "", cost, illegal) for s, way in zip(stretches, ways)]
    kinds = [pa.int64(), *[pa.int32()] * 3, pa.string(), pa.int64(), pa.int64()]
    return pa.Table.from_batches([_table(rows, kinds, _names(CHOSEN))])


def _edits(batches):
    """Per row of a stretch its audit and the roles it leaves; a stretch is one range
    partition, of which four small entries a row are held."""
    kinds = [pa.int64(), pa.string(), pa.list_(pa.string())]
    for (_, _, enter, leave, lacks), rows in _groups(batches, 5):
        tops, backs = entry(enter), []
        for _, initial, fault, copies in rows:
            tops, back = shift(tops, Row(initial, fault, copies))
            backs.append(back)
        edits, _ = walk_back(backs, leave)
        out = [(r[0], audit, [m or "" for m in made]) for r, (audit, made) in zip(rows, edits)]
        if lacks:  # behind the row's own, told apart by a null before them
            pos, audit, made = out[-1]
            out[-1] = (pos, audit + "I" * len(lacks), [*made, None, *[NAMES[x] for x in lacks]])
        for at in range(0, len(out), 10_000):
            yield _table(out[at:at + 10_000], kinds, _names(EDITS))


def turns_of(role: str, text: str, made: list) -> list[tuple[str, str]]:
    """The repaired (role, text) rows that one row leaves."""
    own = made[:made.index(None)] if None in made else made
    behind = made[len(own) + 1:]
    out = [(r, "") for r in own[:-1]]
    if own:
        out.append((own[-1] or role, text))
    return out + [(r, "") for r in behind]


def _streamed(batches):
    """Audit and hash of each long conversation, read in order without holding its text."""
    conv, digest, audit, some, begun = None, None, [], False, False
    for b in batches:
        for c, _, role, text, piece, made in zip(*(x.to_pylist() for x in b.columns)):
            if not begun or c != conv:
                if begun:
                    yield _table([(conv, "".join(audit), digest.hexdigest())], [pa.int64(), pa.string(), pa.string()], _names(STREAMED))
                conv, digest, audit, some, begun = c, hashlib.sha256(), [], False, True
            audit.append(piece)
            for r, t in turns_of(role, text, made):
                digest.update(f"{chr(10) if some else ''}{r}:{t}".encode())
                some = True
    if begun:
        yield _table([(conv, "".join(audit), digest.hexdigest())], [pa.int64(), pa.string(), pa.string()], _names(STREAMED))


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report and turns of the conversations in ``rows`` by stretches."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    key = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    # equal rows become one with a count, in the map tasks already
    own = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("key", key)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = own.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(place).alias("first"))
    held = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    fault = (F.when(F.length(held) == 0, "b").when(place != F.col("first"), "d")
             .when(held.rlike(r"[.!?]\z"), "").otherwise("t"))
    initial = F.substring("role", 1, 1)
    ruled = (own.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
             .select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"),
                     F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial")))
    placed = materialize(ruled.repartitionByRange(*order).sortWithinPartitions(*order)
                         .select("*", F.spark_partition_id().alias("seg"), F.monotonically_increasing_id().alias("pos")), "turns")
    slim = placed.select("conv_id", "seg", "pos", "initial", "fault", "copies")

    def in_order(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys, "pos")

    summaries = materialize(in_order(slim, "conv_id", "seg").mapInArrow(_summaries, SUMMARY), "stretches")
    chosen = materialize(summaries.groupBy("conv_id").applyInArrow(_compose, CHOSEN), "ways")
    ways = chosen.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), "enter", "leave", "lacks")
    edits = (slim.join(ways, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")))
             .select("conv_id", "seg", "enter", "leave", "lacks", "pos", "initial", "fault", "copies"))
    edits = in_order(edits, "conv_id", "seg").mapInArrow(_edits, EDITS)
    edited = materialize(placed.join(edits, "pos").select("conv_id", "pos", "role", "text", "audit", "made"), "edited_turns")
    streamed = in_order(edited, "conv_id").mapInArrow(_streamed, STREAMED)
    counts = summaries.groupBy("conv_id").agg(*[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    costs = chosen.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    spans = (placed.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
             .agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")))
    report = streamed
    for part in (counts, costs, spans):
        part = part.withColumnRenamed("conv_id", "c")
        report = report.join(part, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    report = report.withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    # made: roles of inserted rows, its own last ('' where kept); behind a null those at the end
    made = F.col("made")
    ends = F.coalesce(F.array_position(F.transform(made, lambda r: r.isNull()), True), F.lit(0))
    own_rows = F.when(ends > 0, F.slice(made, 1, (ends - 1).cast("int"))).otherwise(made)
    turn_rows = F.concat(
        F.transform(own_rows, lambda r, i: F.struct(
            F.when(r == "", F.col("role")).otherwise(r).alias("role"),
            F.when(i == F.size(own_rows) - 1, F.col("text")).otherwise("").alias("text"))),
        F.when(ends > 0, F.transform(F.filter(F.slice(made, (ends + 1).cast("int"), F.lit(4)), lambda r: r.isNotNull()),
                                     lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))))
        .otherwise(F.array().cast("array<struct<role:string,text:string>>")))
    turns = (edited.select("conv_id", "pos", F.posexplode(turn_rows).alias("at", "turn"))
             .select("conv_id", (F.col("pos") * 8 + F.col("at")).alias("place"), "turn.role", "turn.text"))
    return report.select(*_names(REPORT)), turns


# --- the operator -------------------------------------------------------------------------

@dataclass
class Repaired:
    report: DataFrame  # one row per conversation: faults, cost, audit, hash
    turns: DataFrame   # the repaired rows: conv_id, place (ascending), role, text


def repair(rows: DataFrame, whole_rows: int = 50_000, whole_chars: int = 32 << 20) -> Repaired:
    """Repair the conversations of ``rows`` (conv_id, turn, role, text and, where a row
    stands for several or for none, copies)."""
    one = F.lit(" ")
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role"), one).alias("role"), F.coalesce(F.col("text"), one).alias("text"),
                       copies.cast("long").alias("copies"))
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("rows"), F.sum(F.octet_length("text") * F.col("copies")).alias("chars"))
    long_ids = materialize(sizes.where((F.col("rows") > whole_rows) | (F.col("chars") > whole_chars))
                           .select(F.col("conv_id").alias("long_id")), "long_conversations")
    some = not long_ids.isEmpty()
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(long_ids, is_long, "left_anti") if some else rows
    whole = (short.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
             .mapInArrow(_whole, WHOLE))
    report = whole.select(*_names(REPORT))
    turns = (whole.select("conv_id", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn"))
             .select("conv_id", F.col("place").cast("long").alias("place"), F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text")))
    if some:
        more, more_turns = _long(rows.join(long_ids, is_long, "left_semi"))
        report, turns = report.unionByName(more), turns.unionByName(more_turns)
    return Repaired(report, turns)


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage that the query repairs, a function of conv_id and turn alone."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, USER).otherwise(shown("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read_table(spark, sf_dir, "conversations"))).report


def _sql() -> str:
    far = "{'c': 1000000000::BIGINT, 'a': '~', 't': ''}"
    to = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    options: dict[str, list[str]] = {q: [f"CASE WHEN true THEN {{'c': d.{q}.c + 3, 'a': d.{q}.a || 'D', 't': d.{q}.t}} END"] for q in "esua"}
    for p in "esua":
        state, made, n = p, "", 0
        while n < 3:
            start, role_text = f"d.{p}.t || '{made}'", "r.role || ':' || r.text || chr(10)"
            for x, q in to[state].items():
                keep = f"{{'c': d.{p}.c + {2 * n} + r.cut, 'a': d.{p}.a || '{'I' * n}K', 't': {start} || {role_text}}}"
                options[q].append(f"CASE WHEN r.fault NOT IN ('b', 'd') AND r.initial = '{x}' THEN {keep} ELSE {far} END")
                if x in NAMES:
                    new = (f"{{'c': d.{p}.c + {2 * n + 2} + r.cut, 'a': d.{p}.a || '{'I' * n}R', "
                           f"'t': {start} || '{NAMES[x]}:' || r.text || chr(10)}}")
                    options[q].append(f"CASE WHEN r.fault NOT IN ('b', 'd') THEN {new} ELSE {far} END")
            x, state = next((x, q) for x, q in to[state].items() if x in NAMES)
            made, n = f"{made}{NAMES[x]}:' || chr(10) || '", n + 1
    step = ",\n         ".join(f"list_min([{', '.join(options[q])}]) AS {q}" for q in "esua")
    end = ("list_min([d.e, {'c': d.s.c + 4, 'a': d.s.a || 'II', 't': d.s.t || 'user:' || chr(10) || 'assistant:' || chr(10)}, "
           "{'c': d.u.c + 2, 'a': d.u.a || 'I', 't': d.u.t || 'assistant:' || chr(10)}, d.a])")
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
                          lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n
  FROM raw, range(2) r(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) AS nth
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n)),
ruled AS (
  SELECT *, left(role, 1) AS initial, (fault = 't')::INTEGER AS cut,
         CASE WHEN k > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS odd
  FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
                       WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM placed)),
tops AS (
  SELECT conv_id, 0 AS k, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS e, {far} AS s, {far} AS u, {far} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT d.conv_id, r.k::INTEGER,
         {step}
  FROM tops d JOIN ruled r ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = d.k + 1),
ended AS (
  SELECT conv_id, arg_max({end}, k) AS best FROM tops d GROUP BY conv_id),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, sum(odd) AS illegal
  FROM ruled GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
       sha256(left(best.t, greatest(length(best.t) - 1, 0))) AS repaired_sha256
FROM ended e LEFT JOIN faults f ON e.conv_id IS NOT DISTINCT FROM f.conv_id
"""


OP12_SQL = _sql()
