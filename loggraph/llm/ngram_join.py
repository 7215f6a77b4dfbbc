"""Operator 2: n-gram Jaccard join by a blocked sparse product.

Documents are rows, word n-grams (64-bit hashes) columns of an incidence matrix; two
documents link when their overlap is at least ``threshold`` percent of their union.

1. One pass makes each document's set: its size, a 64-bit id of the whole set, an odd
   sketch (one parity bit per hashed column, at least as many bits as columns) and its
   prefix, the rarest ``n - ceil(t n) + 1`` columns. Linked sets share a prefix column;
   the order is any fixed one, so "rare" comes from a bounded sample. Documents with
   equal sets are one row from here on.
2. Rows with a common prefix column meet. Columns with the same rows are met once; a
   column with more than ``meet`` rows is cut into pairs of blocks. Within a block the
   size bound and the sketch's lower bound of the symmetric difference discard pairs;
   a spanning forest of the others is kept, never all pairs. Its components are groups
   that no link leaves.
3. Each group's rows are multiplied: blocks of at most ``block_rows`` rows and
   ``block_columns`` entries, every pair of blocks in one task, overlap counts
   accumulated column by column, pairs below the size-derived bound discarded. A task
   returns a spanning forest of its links and, per set, the number of documents it
   links to; the components of the former are the classes, the latter are summed. So
   every link is counted, though the pairs themselves are never written.

No link is lost: the prefix, the size bound and the sketch's bound are all exact.
Two different columns of the same two documents with one hash (about n^2 / 2^64) are
the only way to a wrong count. No step holds an unbounded group in one task.

Defined cases: null or empty text, or blanks only, is the empty set and links with
nothing; texts under n words are one column, the whole sequence; rows with the same
doc_id are counted as they are, each with its own text; a null doc_id never names a
class that has another id; an empty table gives an empty result; other columns are not
read. A row is known by its doc_id and a 64-bit hash of its text; rows alike in both are
copies, of which the near-copy stage keeps one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import Kept
from .common import materialize, only_held, packed, read_table, slices, text_or_empty, unpacked
from .components import connected_components

WORDS, PERCENT = 5, 80
SAMPLE_DOCS, HOT_COLUMNS = 4000, 200_000
MEET = 2048
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 2_000_000
BROADCAST_ROWS = 2_000_000
#: Rows of a class in their order: null ids last, then by text.
ROW = "struct(doc_id IS NULL AS no_id, doc_id, text_key)"
MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)


class Shingler:
    """Sorted distinct n-gram hashes of a text; A-Z lower-cased, words between blanks."""

    def __init__(self, words: int):
        import xxhash

        self.words = words
        self.hashes = Kept(lambda w: xxhash.xxh64_digest(w), 200_000)

    def __call__(self, text: str) -> np.ndarray:
        # bytes.lower and bytes.split know only A-Z and the blanks 0x20, 0x09 to 0x0D
        words = text.encode("utf-8").lower().split()
        h = np.frombuffer(b"".join([self.hashes[w] for w in words]), dtype=">u8").astype(np.uint64)
        k = min(self.words, len(h))
        if not k:
            return h
        n = len(h) - k + 1
        out = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            out = (out ^ h[i:i + n]) * MIX
            out ^= out >> SHIFT
        return np.unique(out)


def shingler(words: int) -> Shingler:
    """One per Python worker and n-gram length."""
    return only_held(("shingler", words), lambda: Shingler(words))


def needed(n, percent: int):
    """Least overlap of a set of n with any linked one."""
    return -(-percent * n // 100)


def prefix(columns: np.ndarray, hot: np.ndarray, hot_order: np.ndarray, percent: int) -> np.ndarray:
    """The first ``n - needed(n) + 1`` columns: those not known as frequent in hash
    order, then the frequent ones in the order of their count."""
    take = len(columns) - needed(len(columns), percent) + 1
    if not len(hot):
        return columns[:take]
    at = np.minimum(np.searchsorted(hot, columns), len(hot) - 1)
    known = hot[at] == columns
    rare = columns[~known]
    if len(rare) >= take:
        return rare[:take]
    often = at[known]
    return np.concatenate([rare, hot[often[np.argsort(hot_order[often], kind="stable")]][:take - len(rare)]])


def sketch_bits(n: int) -> int:
    return min(1 << 14, max(128, 1 << (n - 1).bit_length()))


def odd_sketch(columns: np.ndarray) -> bytes:
    """Parity of the columns per bit; two sketches differ in at most as many bits as
    the sets differ in columns. Half the bits by folding is the sketch of half size."""
    bits = sketch_bits(len(columns))
    counts = np.bincount((columns & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: int, bits: int) -> int:
    return (sketch ^ (sketch >> (bits // 2))) & ((1 << (bits // 2)) - 1)


def forest(ids: list[int], sizes: list[int], sketches: list[bytes], percent: int):
    """Spanning forest of the pairs within the size bound and the sketch bound."""
    m = len(ids)
    if m <= 48:
        bits = [8 * len(s) for s in sketches]
        full = [int.from_bytes(s, "little") for s in sketches]
        half = [folded(s, b) for s, b in zip(full, bits)]
        left = list(range(m))
        while left:
            queue = [left.pop()]
            while queue and left:
                x, rest = queue.pop(), []
                for y in left:
                    a, b = sizes[x], sizes[y]
                    near = 100 * min(a, b) >= percent * max(a, b)
                    if near:
                        sx, sy = (full if bits[x] <= bits[y] else half)[x], (full if bits[y] <= bits[x] else half)[y]
                        near = (sx ^ sy).bit_count() * (100 + percent) <= (a + b) * (100 - percent)
                    if near:
                        queue.append(y)
                        yield ids[x], ids[y]
                    else:
                        rest.append(y)
                left = rest
        return
    size, bits = np.array(sizes), np.array([8 * len(s) for s in sketches])
    full = {}
    for b in np.unique(bits).tolist():
        mine = np.flatnonzero(bits == b)
        rows = np.frombuffer(b"".join([sketches[i] for i in mine]), dtype="<u8").reshape(len(mine), -1)
        at = np.full(m, -1)
        at[mine] = np.arange(len(mine))
        # sketches of 128 bits fold to one word
        full[b] = (at, rows, rows[:, :rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2:])
    left = np.ones(m, dtype=bool)
    for start in range(m):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            x = queue.pop()
            a, b = int(size[x]), int(bits[x])
            some = np.flatnonzero(left & (100 * np.minimum(size, a) >= percent * np.maximum(size, a)))
            if not len(some):
                continue
            for c in (b // 2, b, 2 * b):
                if c not in full:
                    continue
                mine = some[bits[some] == c]
                if not len(mine):
                    continue
                x_row = full[b][1 if c >= b else 2][full[b][0][x]]
                rows = full[c][1 if c <= b else 2][full[c][0][mine]]
                differ = np.bitwise_count(rows ^ x_row).sum(axis=1, dtype=np.int64)
                for y in mine[differ * (100 + percent) <= (a + size[mine]) * (100 - percent)].tolist():
                    left[y] = False
                    queue.append(y)
                    yield ids[x], ids[y]


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def product(ids: list[int], sets: list[np.ndarray], copies: list[int], first: int, percent: int):
    """Overlap counts of the first ``first`` rows with the others, or with all where
    there are no others, by the columns they share. Yields (u, v, 0) for a spanning
    forest of the links and (u, u, n) for a row that links to ``n`` documents here;
    ``copies`` is each row's number of documents."""
    sizes, copies = np.array([len(s) for s in sets]), np.array(copies, dtype=np.int64)
    flat = np.concatenate(sets)
    columns, place = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    count = np.bincount(place, minlength=len(columns))
    ends = np.cumsum(count)
    starts, owner = ends - count, owner[order]
    edges, tree = np.concatenate([[0], np.cumsum(sizes)]), Forest(len(sets))
    two, n_links = first < len(sets), np.zeros(len(sets), dtype=np.int64)
    for i in range(first):
        mine = place[edges[i]:edges[i + 1]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        n = count[mine]
        spread = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        overlap = np.bincount(owner[spread], minlength=len(sets))
        overlap[i] = 0
        if two:  # the first block's own pairs are met in the task of that block alone
            overlap[:first] = 0
        both = sizes + sizes[i]
        linked = np.flatnonzero((overlap > 0) & (100 * overlap >= percent * (both - overlap)))
        n_links[i] += copies[linked].sum()
        if two:
            n_links[linked] += copies[i]
        for j in linked.tolist():
            if tree.join(i, j):
                yield ids[i], ids[j], 0
    for i in np.flatnonzero(n_links).tolist():
        yield ids[i], ids[i], int(n_links[i])


def _grouped(df: DataFrame, keys: list[str], schema: str, names: list[str], kinds: list, of_group):
    """``of_group(rows)`` for the rows (lists of values without the keys) of each key:
    hash-dealt, sorted, and streamed group by group."""
    rest = [c for c in df.columns if c not in keys]

    def run(batches):
        held, key, out = [], None, []

        def made():
            yield from of_group(held)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                k = row[:len(keys)]
                if k != key:
                    if held:
                        out.extend(made())
                    held, key = [], k
                held.append(row[len(keys):])
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if held:
            out.extend(made())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    dealt = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def hot_columns(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent columns of a sample of about SAMPLE_DOCS rows (sorted) and their order
    by count. They only order the prefixes; results do not depend on them."""
    few = docs.sample(min(1.0, SAMPLE_DOCS / max(1, docs.count())), seed=9).select("text")

    def spread(batches):
        shingles = shingler(words)
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64), pa.int64())], ["c"])

    counts = few.mapInArrow(spread, "c long").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where("n >= 3").orderBy(F.desc("n"), "c").limit(HOT_COLUMNS).collect()
    hot = np.array([r["c"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], np.array([r["n"] for r in rows], dtype=np.int64)[order]


def document_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, set_id and, once per task and set, prefix and sketch.
    ``docs`` holds doc_id, text_key and text."""
    hot, hot_order = hot_columns(docs, words)
    names = ["doc_id", "text_key", "n", "set_id", "prefix", "sketch"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        import xxhash

        shingles, seen = shingler(words), set()
        for b in slices(batches):
            out = [[] for _ in names]
            for i, h, t in zip(*(c.to_pylist() for c in b.columns)):
                columns = shingles(t)
                n, p, s, k = len(columns), None, None, None
                if n:
                    k = xxhash.xxh64_intdigest(columns.tobytes()) - (1 << 63)
                    if k not in seen:
                        seen.add(k)
                        p, s = prefix(columns, hot, hot_order, percent).tobytes(), odd_sketch(columns)
                for c, v in zip(out, (i, h, n, k, p, s)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return materialize(docs.mapInArrow(run, "doc_id long, text_key long, n long, set_id long, prefix binary, sketch binary"),
                       "ngram_sets", compression="lz4")


def candidate_groups(rows: DataFrame, percent: int) -> DataFrame:
    """(node, root): sets whose group, which no link leaves, has at least two sets.
    ``rows`` holds one row per set: set_id, n, prefix, sketch."""

    def spread(batches):
        for b in batches:
            ids, prefixes = (c.to_pylist() for c in b.columns)
            columns = np.frombuffer(b"".join(prefixes), dtype=np.int64)
            own = np.repeat(np.array(ids, dtype=np.int64), [len(p) // 8 for p in prefixes])
            for at in range(0, len(own), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(columns[at:at + 500_000]), pa.array(own[at:at + 500_000])], ["c", "set_id"])

    entries = rows.select("set_id", "prefix").mapInArrow(spread, "c long, set_id long")
    # columns with the same sets (count, ends and two hashes of the sets) need to meet once
    met = (entries.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.min("set_id").alias("low"), F.max("set_id").alias("high"),
                                    *[F.bit_xor(F.xxhash64("set_id", F.lit(k))).alias(f"x{k}") for k in (1, 2)])
           .where("m > 1").groupBy("m", "low", "high", "x1", "x2").agg(F.min("c").alias("c")).select("c", "m"))
    blocks = F.ceil(F.col("m") / MEET).cast("int")
    mine = F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("blocks")).cast("int")
    pairs = (entries.join(met, "c").withColumn("blocks", blocks).withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("c", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "set_id"))
    met_rows = pairs.join(rows.select("set_id", "n", "sketch"), "set_id")

    def of_group(held):
        if len(held) > 1:
            yield from forest(*zip(*held), percent)

    edges = _grouped(met_rows.select("c", "b1", "b2", "set_id", "n", "sketch"), ["c", "b1", "b2"], "u long, v long",
                     ["u", "v"], [pa.int64(), pa.int64()], of_group)
    return connected_components(edges)


def _bounded(df: DataFrame, n: int) -> DataFrame:
    """Broadcast a side whose counted rows are few enough; else leave it to a shuffle."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def exact_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v, n): spanning links between sets of the same group (n = 0), and parts of
    the number of documents that a set links to (u = v)."""
    # one document stands for each set: the first row that holds it
    stands = materialize(
        sets.where("n > 0").join(groups.withColumnRenamed("node", "set_id"), "set_id")
        .groupBy("set_id", "root", "n").agg(F.min(F.expr(ROW)).alias("row"), F.count(F.lit(1)).alias("copies"))
        .select("set_id", "root", "n", "row.doc_id", "row.text_key", "copies"),
        "ngram_stands")
    sizes = stands.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("entries"))
    sizes = sizes.select("root", F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("entries") / BLOCK_COLUMNS)).cast("int").alias("blocks"))
    stands = stands.join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("set_id", F.lit(5)), F.col("blocks")).cast("int"))
    few = _bounded(stands.select(F.col("doc_id").alias("stand"), F.col("text_key").alias("stand_key"), "set_id", "root", "mine", "blocks",
                                "copies"), stands.count())
    texts = (docs.join(few, F.col("doc_id").eqNullSafe(F.col("stand")) & (F.col("text_key") == F.col("stand_key")))
             .select("text", "set_id", "root", "mine", "blocks", "copies"))

    def shingled(batches):
        import xxhash

        shingles, seen = shingler(words), set()
        for b in slices(batches):
            out = []
            for text, k, root, mine, blocks, copies in zip(*(c.to_pylist() for c in b.columns)):
                if k in seen:  # a copy of the row
                    continue
                columns = shingles(text)
                if xxhash.xxh64_intdigest(columns.tobytes()) - (1 << 63) == k:  # else another text with this key
                    seen.add(k)
                    out.append((k, root, mine, blocks, copies, columns.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                    ["set_id", "root", "mine", "blocks", "copies", "columns"])

    full = (texts.mapInArrow(shingled, "set_id long, root long, mine int, blocks int, copies long, columns binary")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("root", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"),
                    (F.col("mine") == F.col("other")).alias("alone"), "mine", "set_id", "copies", "columns"))

    def of_group(held):
        known = {}
        for alone, mine, k, copies, columns in held:  # repeated rows of one document come once
            known[k] = (alone, mine, k, copies, columns)
        rows = sorted(known.values())
        first = sum(r[1] == rows[0][1] for r in rows)  # rows of the first block against those of the other
        if len(rows) > 1 and (rows[0][0] or first < len(rows)):
            yield from product([r[2] for r in rows], [np.frombuffer(r[4], dtype=np.uint64) for r in rows],
                               [r[3] for r in rows], first, percent)

    return _grouped(full, ["root", "b1", "b2"], "u long, v long, n long", ["u", "v", "n"],
                    [pa.int64(), pa.int64(), pa.int64()], of_group)


def classified(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, text_key, n, ``low``, the first row (``ROW``) of its class,
    and ``n_links``, the number of documents it links to; ``low`` and ``n_links`` are null
    for the empty set."""
    text = text_or_empty(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    sets = document_sets(docs, words, percent)
    rows = sets.where("prefix IS NOT NULL").dropDuplicates(["set_id"]).select("set_id", "n", "prefix", "sketch")
    groups = candidate_groups(materialize(rows, "ngram_rows", compression="lz4"), percent)
    links = materialize(exact_links(docs, sets, materialize(groups, "ngram_groups"), words, percent), "ngram_links")
    roots = connected_components(links.where("u <> v"))
    linked = links.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    linked = materialize(roots.join(linked, "node").withColumnRenamed("node", "set_id"), "ngram_roots")
    each = sets.where("n > 0").groupBy("set_id").agg(F.min(F.expr(ROW)).alias("first"), F.count(F.lit(1)).alias("copies"))
    each = materialize(each.join(linked, "set_id", "left").select(
        "set_id", "first", F.coalesce("root", "set_id").alias("class"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "ngram_classes")
    low = each.groupBy("class").agg(F.min("first").alias("low"))
    plain = sets.select("doc_id", "text_key", "n", "set_id")
    return (plain.where("n > 0").join(each.join(low, "class").select("set_id", "low", "n_links"), "set_id")
            .select("doc_id", "text_key", "n", "low", "n_links")
            .unionByName(plain.where("n = 0").select("doc_id", "text_key", "n"), allowMissingColumns=True))


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable) and
    n_links, the number of other documents it links to directly."""
    return classified(docs, words, percent, id_col, text_col).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("low").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The documents, all columns, of which one of each class stays: its smallest id
    (null last), of rows with that id the one with the smallest text key."""
    stays = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("text_key") == F.col("low.text_key"))
    rows = (classified(docs, words, percent, id_col, text_col).where("low IS NOT NULL")
            .groupBy("doc_id", "text_key").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("copies"))
            .where("NOT stays OR copies > 1")
            .select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "stays"))
    rows = materialize(rows, "near_copies")
    keyed = packed(docs, F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("key"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key"))
    left = keyed.join(_bounded(rows, rows.count()), same, "left_anti").select("row")
    again = rows.where("stays")
    n = again.count()
    if n:  # rows that stay, but were there more than once
        left = left.unionByName(keyed.join(_bounded(again, n), same, "left_semi").groupBy("id", "key").agg(F.first("row").alias("row")).select("row"))
    return unpacked(left, docs)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"), words=4, percent=85)


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS sh
  FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
l AS (SELECT x, y FROM o WHERE 100 * i >= 85 * (nx + ny - i)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.reach = u.x),
k AS (SELECT x AS doc_id, count(*) AS n FROM u GROUP BY x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.reach) AS component_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links
FROM s JOIN r USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY 1, 2
"""
