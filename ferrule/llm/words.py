"""Numpy kernels over the bytes of Arrow string columns: words and their 64-bit hashes.

A *word* is a maximal run of bytes outside ``0x20`` and ``0x09``-``0x0D``.  All hashes are
deterministic functions of the bytes alone, so every task of every job agrees on them.
A batch is handled in slices of about ``SLICE_BYTES`` of text (at least one whole text), which
bounds the memory of a task by the longest text, not by the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
HASH_BYTES = 1 << 20  # words are hashed in blocks of about so many bytes: eight bytes of work space for each
_WORD_BASE = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BYTE_VALUE[_SEPARATOR] = 0
_BYTE_VALUE_LOWER = _BYTE_VALUE[_LOWER]

_BYTE_VALUE_FOLDED = _BYTE_VALUE_LOWER.copy()  # ASCII punctuation counts for nothing
_BYTE_VALUE_FOLDED[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0

_PLACES = 1 << 16
_MULTIPLIER = mix(np.arange(1, _PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def run_sums(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of the byte values of every run ``start[i]:start[i + 1]`` (the last ends with ``value``), each
    times an unrelated multiplier of its place in the run.  Powers of one base would not do: words of 1,024 letters that
    follow the Thue-Morse sequence have equal sums with their swaps for every base."""
    size = np.diff(np.append(start, len(value)))
    kind = np.int32 if len(value) < 1 << 31 else np.int64
    place = np.arange(int(start[0]), len(value), dtype=kind)
    place -= np.repeat(start.astype(kind), size)
    value = value[int(start[0]):]
    if size.max() <= _PLACES:
        value *= _MULTIPLIER[place]
    else:
        value *= _MULTIPLIER[place & (_PLACES - 1)]
        value *= mix((place >> 16).astype(np.uint64)) | np.uint64(1)  # 1 for the first block
    return np.add.reduceat(value, start - start[0])


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (cached, grown by doubling)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            filled = 1
            while filled < size:
                factor = np.uint64(pow(b, filled, 1 << 64))
                out[filled:2 * filled] = out[:filled] * factor
                filled *= 2
            both.append(out)
        have = _POWERS[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """The words of the texts of one slice, in order."""

    data: np.ndarray      # bytes of all texts
    offsets: np.ndarray   # text i is data[offsets[i]:offsets[i + 1]]
    start: np.ndarray     # byte position of each word
    end: np.ndarray
    first: np.ndarray     # words first[i]:first[i + 1] belong to text i
    hash: np.ndarray      # uint64 per word

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False, fold: bool = False) -> Words:
    """Words and hashes of a string column.  ``lower`` takes A-Z as a-z; ``fold`` also ignores
    ASCII punctuation at the end of a word."""
    data, offsets = text_bytes(column)
    n = len(data)
    sep = _SEPARATOR[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = sep[:-1]
    start = np.flatnonzero(~sep & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = sep[1:]
    end = np.flatnonzero(~sep & (after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    if len(start):
        table = _BYTE_VALUE_FOLDED if fold else _BYTE_VALUE_LOWER if lower else _BYTE_VALUE
        h = np.empty(len(start), dtype=np.uint64)
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(start, start[at] + HASH_BYTES)))
            upto = int(start[to]) if to < len(start) else n
            h[at:to] = run_sums(table[data[start[at]:upto]], start[at:to] - start[at])
            at = to
        if not fold:
            h += (end - start).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        h = mix(h)
    else:
        h = np.zeros(0, np.uint64)
    return Words(data, offsets, start, end, first, h)


def window_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` consecutive words that lie within one text, and
    the index of each window's first word."""
    n = len(words.hash)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(_WORD_BASE, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words.hash * up, out=total[1:])
    h = (total[width:] - total[:n - width + 1]) * down[:n - width + 1]
    h += np.uint64((width * 0x8EBC6AF09C88C6E3) & _MASK)
    left = np.repeat(words.first[1:], np.diff(words.first))[:n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= left)
    return mix(h[at]), at


def sequence_hash(word_hashes: np.ndarray) -> int:
    """Hash of a whole short word sequence, comparable to ``window_hashes`` of its length."""
    n = len(word_hashes)
    up, _ = powers(_WORD_BASE, n)
    h = np.array([np.sum(word_hashes * up, dtype=np.uint64)], dtype=np.uint64)
    h += np.uint64((n * 0x8EBC6AF09C88C6E3) & _MASK)
    return int(mix(h)[0])


def give_back() -> None:
    """Return freed memory of this process to the system.  Python workers outlive their tasks, and several wait beside
    those at work; what they keep of their last task counts as memory of the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def freeing(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``function`` of one group, after which freed memory goes back to the system."""
    def run(table: pa.Table) -> pa.Table:
        out = function(table)
        give_back()
        return out

    return run


def cut(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that a slice holds at most ``size`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The slices (see ``cut``) of the batches of a task; at their end freed memory goes back to the system."""
    for batch in batches:
        yield from cut(batch, text, size)
    give_back()


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column of ``data``'s bytes cut at byte ``offsets``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def ids_of(column: pa.Array) -> np.ndarray:
    """Document ids as int64; a null id becomes the largest int64 and so follows all others."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    """Inverse of ``ids_of``."""
    return pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).max)
