"""Plain-Python reference results for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def lower(text: str | None) -> list[bytes]:
    return [w.lower() for w in words(text)]


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = lower(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def jaccard_components(rows: list[tuple], percent: int = 75) -> dict:
    """{doc_id: (set size, component)} for distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def without_repeats(rows: list[tuple], window: int) -> list[tuple]:
    """[(doc_id, n_words, n_removed, kept text)] in the order of ``rows``; null ids count as largest."""
    key = lambda d: float("inf") if d is None else d
    least: dict = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(least.get(k, float("inf")), key(d))
    out = []
    for d, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < key(d):
                keep[i:i + window] = [False] * window
        out.append((d, len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()))
    return out


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
