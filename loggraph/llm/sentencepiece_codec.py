"""Operator 9: SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a word the table stores the one token that ends the prefix's
encoding. An automaton over all pieces finds the pieces that end at a position; a
piece is the prefix's last token exactly if it is compatible with the last token of
what stands before it: the two side by side must be their own encoding, that is, no
merge across their border comes before a merge that made them. The ids are recovered
from the end of the word backwards, token by token.

Words are encoded apart, which is exact as no piece has a blank mark behind another
character (checked when the model is read); runs of blank marks, whose pieces share
one score, are merged directly and kept by length. Words repeat, so each task keeps
encoded words in a cache of bounded size.

Defined cases: null text is the empty text (begin and end id only); characters outside
the vocabulary become byte pieces; very long words take time in proportion to their
length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import codecs
import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import Kept
from .common import only_held, read_table, slices, text_or_empty

MARK = "▁"
OUT_BYTES = 4 << 20

codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


class PieceBpe:
    """``encode(text)`` and ``decode(ids)`` of a SentencePiece BPE model."""

    def __init__(self, path: str, kept_words: int = 300_000, kept_pairs: int = 300_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.piece, self.bytes, self.rank, self.shown = {}, {}, {}, []
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(text[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.piece[text] = i
                self.rank[i] = -model.get_score(i)
            self.shown.append("" if model.is_control(i) else " ⁇ " if model.is_unknown(i) else text)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        runs = {p for p in self.piece if len(p) > 1 and not p.strip(MARK)}
        probe = "a  b\tcＡﬁ"
        if (len(self.bytes) != 256 or any(MARK in p[1:] for p in self.piece if p not in runs)
                or model.normalize(probe) != MARK + probe.replace(" ", MARK)
                or any(c not in self.piece for p in self.piece for c in p)):
            raise ValueError("a BPE model with byte fallback, plain normalisation and marks at word starts is needed")
        self.runs = runs
        made = [p for p in self.piece if p not in runs and len(p) > 1]
        if len({self.rank[self.piece[p]] for p in made}) != len(made):
            raise ValueError("two pieces of the model have the same score")
        # the two parts of each piece's last merge; pieces that are not their own encoding are left out
        self.parts: dict[int, tuple[int, int]] = {}
        self.odd: set[int] = set()
        self.automaton = ahocorasick.Automaton()
        for p in sorted((p for p in self.piece if p not in runs), key=len):
            i = self.piece[p]
            if len(p) > 1:
                ids, last = self._merge([self.piece[c] for c in p], list(p), last=True)
                if len(ids) > 1:
                    continue
                self.parts[i] = last
                if any(x in self.odd or (x in self.parts and self.rank[x] >= self.rank[i]) for x in last):
                    self.odd.add(i)
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.joined = {(a, b): i for p, i in self.piece.items() if p not in runs
                       for k in range(1, len(p)) if (a := self.piece.get(p[:k])) is not None
                       and (b := self.piece.get(p[k:])) is not None}
        self.text_of = {i: p for p, i in self.piece.items()}
        self.words = Kept(self._word, kept_words)
        self.count = model.get_piece_size()
        self.pairs = Kept(lambda k: self._compatible(divmod(k, self.count)), kept_pairs)
        self.blank_runs = Kept(self._blank_run, 10_000)

    def _merge(self, ids: list[int], texts: list[str], last: bool = False):
        """Merge by rule: the best-scored adjacent pair first, the leftmost of equals."""
        n = len(texts)
        right = list(range(1, n)) + [-1]
        left = [-1] + list(range(n - 1))
        heap, parts = [], None

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.piece.get(texts[a] + texts[b])) is not None:
                heapq.heappush(heap, (self.rank[i], a, b, len(texts[a]), len(texts[b]), i))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, m, k, i = heapq.heappop(heap)
            if len(texts[a]) != m or len(texts[b]) != k:
                continue
            parts = (ids[a], ids[b])
            texts[a], texts[b], ids[a] = texts[a] + texts[b], "", i
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out = [i for i, t in zip(ids, texts) if t]
        return (out, parts) if last else out

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the two tokens side by side are the encoding of their joined text.

        Going back in time from the two tokens, the later of their last merges is
        undone first; a merge across the border that would have come before it shows
        that the encoding is another one."""
        a, b = pair
        if a in self.odd or b in self.odd:
            texts = list(self.text_of[a] + self.text_of[b])
            return self._merge([self.piece[c] for c in texts], texts) == [a, b]
        joined, parts, rank = self.joined, self.parts, self.rank
        late, left_is_late = float("inf"), False
        while True:
            i = joined.get((a, b))
            # equal scores: the merge further left comes first, the border is left of all of b
            if i is not None and (rank[i] < late or (rank[i] == late and not left_is_late)):
                return False
            in_a, in_b = parts.get(a), parts.get(b)
            if in_a is None and in_b is None:
                return True
            left_is_late = in_b is None or (in_a is not None and rank[a] > rank[b])
            if left_is_late:
                late, a = rank[a], in_a[1]
            else:
                late, b = rank[b], in_b[0]

    def last_tokens(self, word: str) -> list[int]:
        """The prefix table: entry e is the last token of ``word[:e]``, -1 where a
        character outside the vocabulary ends it."""
        table = [-1] * (len(word) + 1)
        pairs, count = self.pairs, self.count
        for end, (token, length) in self.automaton.iter(word):
            if table[end + 1] < 0:
                before = table[end + 1 - length]
                if before < 0 or pairs[before * count + token]:
                    table[end + 1] = token
        return table

    def _word(self, word: str) -> bytes:
        """Ids of a word (no blanks inside) with its blank mark, as uint32 bytes."""
        word = MARK + word
        table, at, back = self.last_tokens(word), len(word), []
        while at:
            token = table[at]
            if token >= 0:
                back.append(token)
                at -= len(self.text_of[token])
            else:
                back.extend(self.bytes[b] for b in reversed(word[at - 1].encode("utf-8")))
                at -= 1
        back.reverse()
        return struct.pack(f"<{len(back)}I", *back)

    def _blank_run(self, n: int) -> bytes:
        return np.asarray(self._merge([self.piece[MARK]] * n, [MARK] * n), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids between begin and end id, as little-endian uint32 bytes."""
        if not text:
            return b""
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return b"".join([self.words[w] for w in words])
        mark = np.asarray([self.piece[MARK]], dtype="<u4").tobytes()
        out, blanks = [], 0
        for w in words:
            if not w:
                blanks += 1
                continue
            ids = self.words[w]
            if blanks:
                alone = ids[:4] == mark  # the word's own mark joins the run before it
                out.append(self.blank_runs[blanks + alone])
                ids, blanks = ids[4 * alone:], 0
            out.append(ids)
        if blanks:
            out.append(self.blank_runs[blanks])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8 (each byte that is
        no part of a character becomes U+FFFD), marks as spaces but the first."""
        first = next((i for i in ids if self.shown[i]), None)
        if self.byte_of.keys().isdisjoint(ids):
            out = "".join([self.shown[i] for i in ids])
        else:
            shown, raw = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    shown.append(raw.decode("utf-8", "one_by_one"))
                    raw.clear()
                shown.append(self.shown[i])
            shown.append(raw.decode("utf-8", "one_by_one"))
            out = "".join(shown)
        if first is not None and self.shown[first].startswith(MARK):
            out = out[1:]
        return out.replace(MARK, " ")


def piece_bpe(path: str) -> PieceBpe:
    """One codec per Python worker and model."""
    return only_held(("piece_bpe", path), lambda: PieceBpe(path))


def _mapped(df: DataFrame, fields: list[tuple[str, str, pa.DataType]], row) -> DataFrame:
    names, kinds = [f[0] for f in fields], [f[2] for f in fields]

    def run(batches):
        out, size = [[] for _ in names], 0
        for b in slices(batches):
            for values in zip(*(c.to_pylist() for c in b.columns)):
                made, weight = row(values)
                for c, v in zip(out, made):
                    c.append(v)
                size += weight
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out, size = [[] for _ in names], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return df.mapInArrow(run, ", ".join(f"{f[0]} {f[1]}" for f in fields))


IDS = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("ids", "binary", pa.binary())]
TEXT = ("text", "string", pa.string())


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def _framed(bpe: PieceBpe, text: str) -> bytes:
    return np.uint32(bpe.bos).tobytes() + bpe.encode(text) + np.uint32(bpe.eos).tobytes()


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (uint32 bytes, with begin and end id) of whole texts."""

    def row(values):
        ids = _framed(piece_bpe(model), values[1])
        return (values[0], len(ids) // 4, ids), len(ids)

    return _mapped(_documents(docs, id_col, text_col), IDS, row)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded ``text``."""

    def row(values):
        text = piece_bpe(model).decode(np.frombuffer(values[2], dtype="<u4").tolist())
        return (*values, text), len(values[2]) + len(text)

    return _mapped(encoded.select("doc_id", "n_tokens", "ids"), [*IDS, TEXT], row)


def encode_and_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both in one task: doc_id, n_tokens, ids and the text decoded from the ids."""

    def row(values):
        bpe = piece_bpe(model)
        ids = _framed(bpe, values[1])
        text = bpe.decode(np.frombuffer(ids, dtype="<u4").tolist())
        return (values[0], len(ids) // 4, ids, text), len(ids) + len(text)

    return _mapped(_documents(docs, id_col, text_col), [*IDS, TEXT], row)


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    model = model or public_tokenizers.path("piece_bpe_32k.model")
    out = encode_and_decode(read_table(spark, sf_dir, "documents"), model)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("text", 256).alias("decoded_sha256"))
