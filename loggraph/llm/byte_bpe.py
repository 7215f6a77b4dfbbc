"""Byte-level BPE ids through the tokenizers library, word by word.

The vocabulary's merges never cross its pre-token pattern, so a text's ids are those
of its words in a row. Words repeat; each task asks the library once for a word and
keeps the answer in a cache of bounded size."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only_held

#: Letters and numbers up to U+00FF, as classes of a pattern.
LETTER, NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The pre-token pattern of byte-level vocabularies with ``use_regex`` (fixed value:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+),
#: for texts of the characters of PLAIN.
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
#: A lone space is no sure word start where both neighbours are blank, or at the end behind a blank.
BLANK_RUN = re.compile(r"\s (?:\s|\Z)")
#: Characters whose class is the same in every Unicode version of the pattern engines.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xff]*")


#: The same pattern over many stretches of a text at once, a zero character before each; it
#: stays on the first match of its stretch and is all of an empty one.
STOP = "\0"
STRETCHES = re.compile(rf"{STOP}?(?:'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}{STOP}]+"
                       rf"|\s+(?![^\s{STOP}])|\s+)|{STOP}")
#: BLANK_RUN and characters outside PLAIN for Arrow's expressions, whose ``\\s`` is ASCII only.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK_RUNS, NOT_PLAIN = rf"{BLANK} (?:{BLANK}|\z)", r"[^\t-\r\x20-\x7e\x{a1}-\x{ff}]"


#: Words that a task keeps; twice as many in two generations (about 200 bytes each).
KEPT_WORDS = 500_000
PACKED = [struct.Struct(f"<{n}I").pack for n in range(64)]


class Kept(dict):
    """A cache of at most ``2 * limit`` answers: when full, the older half goes."""

    def __init__(self, ask, limit: int):
        super().__init__()
        self.ask, self.limit, self.old = ask, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.ask(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it prints, else 256 onward."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBpe:
    """``ids(text)``: the library's ids of a whole text as little-endian uint32 bytes."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                        and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                        and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        shown = byte_letters()
        self.space = shown[ord(" ")]
        #: byte letters of the characters up to U+00FF
        self.letters = {c: "".join(shown[b] for b in chr(c).encode("utf-8")) for c in range(256)}
        self.ask = self.tok.model.tokenize
        self.limit, self.words, self.older = kept_words, {}, {}
        self.others = Kept(lambda p: self._asked(p.translate(self.letters)), kept_words // 8)
        self.shown = self.letters | {ord(STOP): None}
        self.pieces, self.older_pieces = {STOP: b""}, {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _asked(self, letters: str) -> bytes:
        """The library's ids of one pre-token, given in byte letters."""
        ids = [t.id for t in self.ask(letters)]
        return PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of ``word`` behind a space. Letters alone are one pre-token; a character
        of another class behind letters is the next one."""
        if word.isalpha():
            if word.isascii():
                return self._asked(self.space + word)
            if max(word) <= "\xff":
                return self._asked(self.space + word.translate(self.letters))
        elif word[:-1].isalpha() and word[-1].isascii():
            return self._held(word[:-1]) + self.others[word[-1]]
        return self._cut(f" {word}")

    def _cut(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text):
            return self._whole(text)
        return b"".join([self._held(p[1:]) if p[0] == " " and p[1:].isalpha() else self.others[p] for p in PATTERN.findall(text)])

    def _held(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = self.older.get(word) or self._word(word)
        return found

    def ids(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in self.special) or BLANK_RUN.search(text):
            return self._whole(text)
        words = text.split(" ")
        head = self._cut(words[0]) if words[0] else b""
        del words[0]
        if len(self.words) > self.limit:
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        out = list(map(known.get, words))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            w = words[at]
            found = known.get(w)  # it may have come with another word
            if found is None:
                found = known[w] = older.get(w) or self._word(w)
            out[at] = found
        return head + b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """Ids of a match of STRETCHES."""
        if piece[:2] == f"{STOP} " and piece.isascii() and piece[2:].isalpha():
            return self._asked(self.space + piece[2:])
        return self._asked(piece.translate(self.shown))

    def _looked_up(self, pieces: list[str], ask) -> pa.Array:
        """Ids of each piece, from the cache or ``ask``."""
        if len(self.pieces) > self.limit:
            self.pieces, self.older_pieces = {STOP: b""}, self.pieces
        known, older = self.pieces, self.older_pieces
        out = list(map(known.get, pieces))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            p = pieces[at]
            found = known.get(p)  # it may have come with another place
            if found is None:
                found = known[p] = older.get(p) or ask(p)
            out[at] = found
        return pa.array(out, pa.large_binary())

    def _joined(self, stretches: pa.Array) -> pa.Array:
        """Ids of stretches of PLAIN characters."""
        if not len(stretches):
            return pa.array([], pa.large_binary())
        row = pa.ListArray.from_arrays(pa.array([0, len(stretches)], pa.int32()), stretches)
        pieces = STRETCHES.findall(STOP + pc.binary_join(row, pa.scalar(STOP, pa.large_string()))[0].as_py())
        _, offsets, data = self._looked_up(pieces, self._piece).buffers()
        # the matches of a stretch end where its characters, and its stop, end
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(ends, np.cumsum(pc.utf8_length(stretches).to_numpy() + 1))
        offsets = np.frombuffer(offsets, np.int64, len(pieces) + 1)[np.concatenate([[0], last + 1])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stretches), [None, pa.py_buffer(offsets), data])

    def many(self, texts: pa.Array) -> list[bytes]:
        """``ids`` of each text of a block (no nulls). Each distinct word of the block is cut
        and looked up once, not each word; Arrow puts the answers in place."""
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, BLANK_RUNS)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = whole.to_numpy(zero_copy_only=False) | (not self.by_word)
        out = [self._whole(texts[i].as_py()) if w else b"" for i, w in enumerate(whole.tolist())]
        cut = np.flatnonzero(~whole)
        if not len(cut):
            return out
        split = pc.split_pattern(texts.take(pa.array(cut)), " ")
        starts, words = split.offsets.to_numpy(), split.values
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        # the first word of a text has no space before it
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        stretches = pa.concat_arrays([pc.binary_join_element_wise(none, coded.dictionary, space),
                                      words.take(pa.array(starts[:-1]))])
        at[starts[:-1]] = len(coded.dictionary) + np.arange(len(cut))
        odd = pc.match_substring_regex(stretches, NOT_PLAIN).to_numpy(zero_copy_only=False)
        place = np.empty(len(odd), np.int64)
        place[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(odd))
        mask = pa.array(odd)
        answers = pa.concat_arrays([
            self._joined(stretches.filter(pc.invert(mask))),
            self._looked_up([STOP + w for w in stretches.filter(mask).to_numpy(zero_copy_only=False)],
                            lambda p: self._whole(p[1:]))])
        ids = answers.take(pa.array(place[at]))
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[starts].tolist()
        data = memoryview(data) if data is not None else b""
        for i, a, b in zip(cut.tolist(), ends, ends[1:]):
            out[i] = bytes(data[a:b])
        return out


def byte_bpe(path: str, kept_words: int = KEPT_WORDS) -> ByteBpe:
    """One encoder per Python worker and vocabulary."""
    return only_held(("byte_bpe", path, kept_words), lambda: ByteBpe(path, kept_words))
