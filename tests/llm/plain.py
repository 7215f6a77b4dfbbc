"""Plain Python statements of the contracts, to hold the operators against."""

import hashlib
import re

BLANKS = re.compile("[\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact_copies(rows):
    """rows: (doc_id, text) -> {doc_id: (keep_id, size, sha)}"""
    key = {i: sha(BLANKS.sub(" ", t or "")) for i, t in rows}
    groups = {}
    for i, k in key.items():
        groups.setdefault(k, []).append(i)
    return {i: (min(groups[k]), len(groups[k]), k) for i, k in key.items()}


def line_drops(rows):
    """rows: (doc_id, text) -> {doc_id: (n_lines, n_dropped, kept text)}"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text, words):
    w = [x for x in BLANKS.split((text or "").translate(UPPER)) if x]
    if not w:
        return set()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))}


def near_classes(rows, words, percent):
    """rows: (doc_id, text) -> {doc_id: (set size, smallest reachable id)}"""
    sets = {i: shingles(t, words) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}
