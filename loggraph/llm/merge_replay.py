"""Operator 11: byte-level BPE by replaying the merges over all words of a block at once.

A block (some megabytes of texts of one task) is cut into pre-tokens; the distinct ones
that the task does not know yet are laid end to end as one array of symbols, one per
byte, linked to their neighbours inside the word. An inverted index holds, for each rank,
the positions at which a pair of that rank begins. The ranks are then taken in order:
every merge is applied at all its positions, left to right, and only the two pairs that
touch the new symbol enter the index again. When no rank is left, the symbols still
standing are the ids of all words.

Ranks are those of joined byte strings, so a merge may bring up a pair of a rank that was
already passed. Such a word's order is no longer that of the ranks; it is set aside and
merged alone, best rank first, so that ids are always those of the library.

Nothing is shuffled and nothing is learned from the corpus: each task replays its own
blocks, and a lost executor costs only its tasks. Known words are kept between blocks up
to ``KEPT_WORDS``; a block holds ``BLOCK_CHARS`` of text and at least one text.

Defined cases: null text is the empty text (no ids, empty decoded bytes); special tokens
in a text are ordinary text; blanks of any length, long words and any character are
encoded as the library does; rows with the same or no doc_id are encoded as they are; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, only_held, read_table, text_or_empty

BLOCK_CHARS = 4 << 20
KEPT_WORDS = 300_000
#: Symbols of one replay: the arrays stay within some tens of megabytes.
REPLAY_BYTES = 2 << 20
#: A blank before a space whose other neighbour is blank too, or the end: the space is no
#: sure start of a pre-token.
BLANK_RUN = re.compile(r"\s (?:\s|\Z)")
CODED = "doc_id long, ids array<int>, decoded binary"


class MergeReplay:
    """Encoder and decoder of one file of ranks and one pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.cut = regex.compile(pattern).findall
        with open(ranks_path, "rb") as f:
            rank_of = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.bytes_of = dict(zip(rank_of.values(), rank_of))
        self.size = max(self.bytes_of) + 1
        self.of_byte = np.array([rank_of[bytes([b])] for b in range(256)], dtype=np.int32)
        #: (left id) * size + (right id) -> id of the joined bytes; the same as sorted arrays
        self.rank_of = {a * self.size + b: r for t, r in rank_of.items() for k in range(1, len(t))
                        if (a := rank_of.get(t[:k])) is not None and (b := rank_of.get(t[k:])) is not None}
        self.keys = np.array([*sorted(self.rank_of), np.iinfo(np.int64).max])
        self.ranks = np.array([*(self.rank_of[k] for k in self.keys[:-1].tolist()), -1])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _alone(self, word: bytes) -> bytes:
        """One word, best rank first, the leftmost of equals."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, size = len(ids), self.size
        right, left, heap = [*range(1, n), -1], [-1, *range(n - 1)], []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (r := self.rank_of.get(ids[i] * size + ids[right[i]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[right[i]]))

        for i in range(n):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return np.asarray([x for x in ids if x >= 0], dtype="<i4").tobytes()

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair key, -1 where its bytes are no token."""
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each of the non-empty ``words``."""
        size, lengths = self.size, np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        starts, n = ends - lengths, int(ends[-1])
        # place n stands for "no neighbour"; no pair holds its symbol
        symbols = np.append(self.of_byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64), -1)
        right, left = np.arange(1, n + 2), np.arange(-1, n)
        right[ends - 1], left[starts] = n, n
        index: dict[int, list[np.ndarray]] = {}
        passed: list[np.ndarray] = []  # places where a pair of a passed rank came up

        def enter(places: np.ndarray, keys: np.ndarray, rank: int) -> None:
            found = self._ranks(keys)
            some = np.flatnonzero(found >= 0)
            if not len(some):
                return
            order = some[np.argsort(found[some], kind="stable")]
            ranks, places = found[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, group in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
                if r > rank:
                    index.setdefault(r, []).append(group)
                else:
                    passed.append(group)

        enter(np.arange(n), np.where(right[:n] < n, symbols[:n] * size + symbols[1:], -1), -1)
        for rank in range(size):
            groups = index.pop(rank, None)
            if groups is None:
                continue
            i = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            j = right[i]
            # a place of the index may have been merged away or changed since
            alive = (symbols[i] >= 0) & (symbols[j] >= 0)
            alive[alive] = self._ranks(symbols[i[alive]] * size + symbols[j[alive]]) == rank
            if not alive.all():
                i, j = i[alive], j[alive]
            if not len(i):
                continue
            chained = j[:-1] == i[1:]
            if chained.any():  # pairs that share a symbol: every other one, from the left
                steps = np.arange(len(i))
                begins = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), steps, 0))
                odd = (steps - begins) % 2 == 0
                i, j = i[odd], j[odd]
            k = right[j]
            touching = np.flatnonzero(k[:-1] == i[1:])
            if len(touching):  # merged one after another, the first could bring up a passed rank
                between = self._ranks(rank * size + symbols[i[touching + 1]])
                passed.append(i[touching[(between >= 0) & (between < rank)]])
            symbols[i], symbols[j] = rank, -1
            right[i], left[k] = k, i
            h = left[i]
            places = np.concatenate([h, i])
            enter(places, np.where(symbols[np.concatenate([h, k])] < 0, -1,
                                   np.concatenate([symbols[h] * size + rank, rank * size + symbols[k]])), rank)
        symbols = symbols[:n].astype("<i4")
        standing = symbols >= 0
        raw, counts = symbols[standing].tobytes(), np.add.reduceat(standing, starts)
        cuts = np.concatenate([[0], np.cumsum(counts) * 4]).tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if passed:
            for w in set(np.searchsorted(ends, np.concatenate(passed), side="right").tolist()):
                out[w] = self._alone(words[w])
        return out

    def _learn(self, tokens: Iterable[str]) -> dict[str, bytes]:
        """Ids of the distinct pre-tokens, by replays of at most about REPLAY_BYTES."""
        out, names, words, held = {}, [], [], 0
        for token in tokens:
            word = token.encode("utf-8")
            names.append(token)
            words.append(word)
            held += len(word)
            if held >= REPLAY_BYTES:
                out.update(zip(names, self.replay(words)))
                names, words, held = [], [], 0
        if words:
            out.update(zip(names, self.replay(words)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a block of texts, as little-endian 32-bit integers."""
        cut = self.cut
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        known = self.known
        # a text is its words after single spaces where that is safe, else its pre-tokens
        split = [None if BLANK_RUN.search(t) else t.split(" ") for t in texts]
        whole = [cut(t if words is None else words[0]) for t, words in zip(texts, split)]
        fresh = set()
        for words in split:
            if words:
                fresh.update(words[1:])
        fresh = fresh.difference(known)
        known.update([(w, self.older[w]) for w in fresh if w in self.older])
        fresh = fresh.difference(known)
        parts = {w: [f" {w}"] if w.isalpha() else cut(f" {w}") for w in fresh}
        tokens = set().union(*whole, *parts.values()) if parts or whole else set()
        ids = {t: known[t[1:]] for t in tokens if t[0] == " " and t[1:] in known}
        ids.update(self._learn(tokens.difference(ids)))
        for w, p in parts.items():
            known[w] = b"".join([ids[t] for t in p])
        return [b"".join([*[ids[t] for t in head], *[known[w] for w in (words or ())[1:]]])
                for head, words in zip(whole, split)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def merge_replay(ranks_path: str, pattern: str) -> MergeReplay:
    """One codec per Python worker, file and pattern."""
    return only_held(("merge_replay", ranks_path, pattern), lambda: MergeReplay(ranks_path, pattern))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids and the bytes decoded from the ids, of whole texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def code(batches):
        codec = merge_replay(ranks_path, pattern)
        for block in blocks(batches, block_chars):
            coded = [np.frombuffer(x, "<i4") for x in codec.encode(block.column(1).to_pylist())]
            ends = np.cumsum([0] + [len(x) for x in coded]).astype(np.int32)
            flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            decoded = pa.array([codec.decode(x.tolist()) for x in coded], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(code, CODED)


def op11_merge_replay(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(read_table(spark, sf_dir, "documents"),
                          ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
