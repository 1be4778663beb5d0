"""Byte-level BPE by a segment tree of pair ranks, and its inverse.

The text is split by the vocabulary's pattern; each match is merged on its own.  Over the byte
positions of a match a segment tree stores, per node, the smallest ``rank * size + position``
of the adjacent live pairs below it, so its root is the leftmost pair of lowest rank.  A
merge joins two live neighbours and changes three leaves (the merged position, the absorbed
one and the left neighbour), each followed up to the root: O(log n) per merge.

Short matches are merged many at a time: a batch of matches with the same tree size forms a
matrix of trees, and each step takes one merge in every tree that still has a ranked pair.
Matches longer than ``WIDE`` bytes use one tree each.  The results of frequent matches are
kept in a bounded per-worker cache (a matter of speed only).

Cases: a null or empty text has no ids; a text of any length is encoded whole; strings that
look like special tokens are ordinary text; repeated rows give repeated results; an empty
table gives an empty result; extra columns are carried in ``row``.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.piece_split import distinct, piece_hashes, piece_starts, plain_texts
from ferrule.llm.rows import whole_row, with_fields
from ferrule.llm.words import binary_array, slices, text_bytes

WIDE = 64            # longer matches get a tree of their own
CACHE_ENTRIES = 150_000
_NONE = np.int64(1) << 62

@lru_cache(maxsize=2)
def _unicode_pattern(pattern: str):
    import regex

    return regex.compile(pattern)


class Ranks:
    """A rank file: token bytes by id, and the rank of the concatenation of two tokens."""

    def __init__(self, path: str):
        self.tokens: dict[int, bytes] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.tokens[int(rank)] = base64.b64decode(token)
        rank_of = {token: rank for rank, token in self.tokens.items()}
        keys, values = [], []
        for rank, token in self.tokens.items():
            for cut in range(1, len(token)):
                left, right = rank_of.get(token[:cut]), rank_of.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.byte_rank = np.array([rank_of[bytes([b])] for b in range(256)], dtype=np.int64)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(1) << 62)
        self.values = np.append(np.array(values, dtype=np.int64)[order], 0)
        self.pair = dict(zip(keys, values, strict=True))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """Merge one match with a single segment tree (plain integers)."""
    n = len(piece)
    ids = [int(x) for x in ranks.byte_rank[np.frombuffer(piece, np.uint8)]]
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    none = int(_NONE)
    pair = ranks.pair
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = pair.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int) -> None:
        j = after[i]
        rank = pair.get(ids[i] << 32 | ids[j]) if j < n else None
        value = none if rank is None else rank * size + i
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while tree[1] < none:
        rank, i = divmod(tree[1], size)
        j = after[i]
        ids[i] = rank
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        ids[j] = -1
        after[j] = n
        put(i)
        put(j)
        if before[i] >= 0:
            put(before[i])
    return [x for x in ids if x >= 0]


def _merge_matrix(ids: np.ndarray, length: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Merge many matches of one tree size: ``ids`` is (matches, size), -1 where absorbed."""
    rows, size = ids.shape
    shift = size.bit_length() - 1
    column = np.arange(size)
    tree = np.full((rows, 2 * size), _NONE, dtype=np.int64)
    live = column[None, :] + 1 < length[:, None]
    rank = np.full((rows, size), -1, dtype=np.int64)
    r, c = np.nonzero(live)
    rank[r, c] = ranks.lookup(ids[r, c], ids[r, c + 1])
    tree[:, size:] = np.where(rank >= 0, (rank << shift) | column, _NONE)
    level = size
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half
    after = np.broadcast_to(column + 1, (rows, size)).copy()
    before = np.broadcast_to(column - 1, (rows, size)).copy()

    def put(row: np.ndarray, at: np.ndarray) -> None:
        to = after[row, at]
        ok = to < length[row]
        value = np.full(len(row), _NONE, dtype=np.int64)
        found = ranks.lookup(ids[row[ok], at[ok]], ids[row[ok], to[ok]])
        value[ok] = np.where(found >= 0, (found << shift) | at[ok], _NONE)
        node = at + size
        tree[row, node] = value
        for _ in range(shift):
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    active = np.flatnonzero(tree[:, 1] < _NONE)
    while len(active):
        top = tree[active, 1]
        i = top & (size - 1)
        j = after[active, i]
        ids[active, i] = top >> shift
        ids[active, j] = -1
        nxt = after[active, j]
        after[active, i] = nxt
        inside = nxt < length[active]
        before[active[inside], nxt[inside]] = i[inside]
        after[active, j] = length[active]
        put(active, i)
        put(active, j)
        prior = before[active, i]
        has = prior >= 0
        put(active[has], prior[has])
        active = active[tree[active, 1] < _NONE]
    return ids


def merge_many(texts: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of each match, as little-endian unsigned 32-bit integers."""
    out: list = [None] * len(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    for size in (2, 4, 8, 16, 32, WIDE):
        chosen = np.flatnonzero((lengths <= size) & (lengths > size // 2) if size > 2 else lengths <= 2)
        step = max(1, (1 << 16) // size)
        for at in range(0, len(chosen), step):
            rows = chosen[at:at + step]
            length = lengths[rows]
            ids = np.full((len(rows), size), -1, dtype=np.int64)
            mask = np.arange(size)[None, :] < length[:, None]
            ids[mask] = ranks.byte_rank[np.frombuffer(b"".join([texts[k] for k in rows]), np.uint8)]
            ids = _merge_matrix(ids, length, ranks)
            kept = ids >= 0
            packed = ids[kept].astype("<u4").tobytes()
            begin = 0
            for k, end in zip(rows.tolist(), (4 * np.cumsum(kept.sum(axis=1))).tolist(), strict=True):
                out[k] = packed[begin:end]
                begin = end
    for k in np.flatnonzero(lengths > WIDE).tolist():
        out[k] = np.array(merge_one(texts[k], ranks), dtype="<u4").tobytes()
    return out


def _same_runs(x: np.ndarray, x_begin: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_begin: np.ndarray,
               y_size: np.ndarray) -> bool:
    """Whether the runs of ``x`` and ``y`` are equal one by one."""
    if not np.array_equal(x_size, y_size):
        return False
    total = int(x_size.sum())
    kind = np.int32 if max(len(x), len(y), total) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    before = np.cumsum(x_size) - x_size
    whole = total == len(x) and np.array_equal(before, x_begin)
    mine = x if whole else x[at + np.repeat((x_begin - before).astype(kind), x_size)]
    at += np.repeat((y_begin - before).astype(kind), x_size)
    return np.array_equal(mine, y[at])


class PieceCache:
    """Encodes texts match by match, keeping the ids of the matches met lately.

    The cache is a sorted array of match hashes with their bytes and ids end to end; it holds at most
    ``entries`` matches besides those of the slice at hand.  A hash only finds a match: its bytes are
    compared before its ids are used, and a slice whose hashes collide is encoded without them."""

    def __init__(self, pattern: str, encode_pieces: Callable[[list[bytes]], list[bytes]], entries: int = CACHE_ENTRIES):
        import public_tokenizers

        self.pattern, self.encode_pieces, self.entries = pattern, encode_pieces, entries
        self.standard = pattern == public_tokenizers.PATTERN
        self.hash, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")
        self.raw, self.raw_begin, self.raw_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        coded = self.encode_pieces(pieces)
        size = np.array([len(x) // 4 for x in coded], dtype=np.int64)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(coded), "<u4")))
        raw_size = np.array([len(x) for x in pieces], dtype=np.int64)
        raw_begin = len(self.raw) + np.cumsum(raw_size) - raw_size
        self.raw = np.concatenate((self.raw, np.frombuffer(b"".join(pieces), np.uint8)))
        h = np.concatenate((self.hash, h))
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.begin, self.size = np.concatenate((self.begin, begin))[order], np.concatenate((self.size, size))[order]
        self.raw_begin = np.concatenate((self.raw_begin, raw_begin))[order]
        self.raw_size = np.concatenate((self.raw_size, raw_size))[order]

    def _keep(self, at: np.ndarray) -> None:
        """Forget all entries but those at ``at``."""
        def rest(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
            spans = [flat[b:b + n] for b, n in zip(begin[at].tolist(), size[at].tolist(), strict=True)]
            return np.concatenate(spans) if spans else flat[:0].copy()

        self.ids, self.raw = rest(self.ids, self.begin, self.size), rest(self.raw, self.raw_begin, self.raw_size)
        self.hash, self.size, self.raw_size = self.hash[at], self.size[at], self.raw_size[at]
        self.begin, self.raw_begin = np.cumsum(self.size) - self.size, np.cumsum(self.raw_size) - self.raw_size

    def _without_hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` by the bytes of the matches alone."""
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        some = list(dict.fromkeys(pieces))
        ids = dict(zip(some, self.encode_pieces(some), strict=True))
        total = np.cumsum([0] + [len(ids[p]) // 4 for p in pieces])
        return np.frombuffer(b"".join(ids[p] for p in pieces), "<u4"), total[first]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        return at, self.hash[at] == h if len(self.hash) else np.zeros(len(h), bool)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the first id of each text (and the end)."""
        if column.null_count:
            column = column.fill_null("")
        data, offsets = text_bytes(column)
        plain = plain_texts(data, offsets) if self.standard else np.zeros(len(column), bool)
        if plain.all():
            start, first = piece_starts(data, offsets), None
        else:  # the matches of the other texts come from the regular expression, as byte lengths
            find = _unicode_pattern(self.pattern).findall
            starts = []
            for k, text in enumerate(column.to_pylist()):
                a, b = int(offsets[k]), int(offsets[k + 1])
                if plain[k]:
                    starts.append(a + piece_starts(data[a:b], np.array([0, b - a])))
                else:
                    lengths = np.array([len(p.encode()) for p in find(text)], dtype=np.int64)
                    starts.append(a + np.cumsum(lengths) - lengths)
            start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        first = np.searchsorted(start, offsets)
        end = np.append(start[1:], len(data))
        h, first_at, index = distinct(piece_hashes(data, start))
        if not _same_runs(data, start, end - start, data, start[first_at][index], (end - start)[first_at][index]):
            return self._without_hashes(data, start, end, first)
        if len(self.hash) > self.entries:
            at, known = self._find(h)  # only what this slice needs is kept
            self._keep(np.sort(at[known]))
        at, known = self._find(h)
        at, found = at[known], first_at[known]
        if not _same_runs(data, start[found], end[found] - start[found], self.raw, self.raw_begin[at], self.raw_size[at]):
            return self._without_hashes(data, start, end, first)
        if not known.all():
            new = first_at[~known]
            raw = data.tobytes()
            self._learn(h[~known], [raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        at, _ = self._find(h)
        size = self.size[at][index]
        total = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(self.begin[at][index] - total[:-1], size) + np.arange(total[-1])
        return self.ids[source], total[first]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.encode = PieceCache(pattern, lambda some: merge_many(some, self.ranks)).encode
        tokens = [self.ranks.tokens.get(i, b"") for i in range(max(self.ranks.tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_begin = np.cumsum(self.token_size) - self.token_size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids end to end, and where each id's bytes begin (and the end)."""
        size = self.token_size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(self.token_begin[ids] - total[:-1], size) + np.arange(total[-1])
        return self.token_bytes[source], total


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def bpe_round_trip(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text",
                   carry: Column | None = None) -> DataFrame:
    """Encode and decode every whole text.

    Returns ``row`` (``carry``, by default a struct of all input columns), ``ids`` (binary:
    little-endian unsigned 32-bit) and ``decoded`` (binary: the bytes of the decoded ids).
    One narrow pass, no shuffle.
    """
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    carry = whole_row(docs) if carry is None else carry
    source = docs.select(carry.alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path, pattern)
        for part in slices(batches, size=2 << 20):
            ids, first = both.encode(part.column("text"))
            decoded, begin = both.decode(ids)
            yield pa.RecordBatch.from_arrays([part.column("row"), binary_array(ids.astype("<u4"), 4 * first),
                                              binary_array(decoded, begin[first])], ["row", "ids", "decoded"])

    return source.mapInArrow(run, with_fields([source.schema["row"]], "ids binary, decoded binary"))
