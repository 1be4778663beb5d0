"""The standard split pattern over whole Arrow columns at once.

For *plain* texts (printable ASCII, tab, line breaks and the letters of Latin-1) the pattern's matches follow from
the classes of the bytes: letters, digits, white space, others.  Runs of a class are matches, except that the last
blank before a run belongs to it, a white-space run before other text gives its last character off, and a lone
apostrophe takes the letters of a contraction.  Other texts go through the regular expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ferrule.llm.words import mix, run_sums

_LETTER, _DIGIT, _SPACE, _OTHER, _STRANGE = 0, 1, 2, 3, 4
_CLASS = np.full(256, _STRANGE, dtype=np.uint8)
_CLASS[32:127] = _OTHER
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0x80:0xC0] = _LETTER  # continuation bytes
_CLASS[0xC3] = _LETTER
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def plain_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts are plain."""
    strange = _CLASS[data] == _STRANGE
    sign = np.flatnonzero((data == 0x97) | (data == 0xB7))  # the signs among the letters of C3
    sign = sign[sign > 0]
    strange[sign[data[sign - 1] == 0xC3]] = True
    at = np.flatnonzero(strange)
    plain = np.ones(len(offsets) - 1, dtype=bool)
    plain[np.searchsorted(offsets, at, "right") - 1] = False
    return plain


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every match in plain texts ``data[offsets[i]:offsets[i + 1]]``; a match ends where the
    next starts, or with its text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[offsets] = True
    run = np.ones(n, dtype=bool)
    run[1:] = (kind[1:] != kind[:-1]) | text_start[1:n]
    mark = run.copy()
    after = np.flatnonzero(run[1:] & (kind[:-1] == _SPACE) & ~text_start[1:n]) + 1  # text after white space
    mark[after - 1] = True
    mark[after[data[after - 1] == 32]] = False
    lone = np.flatnonzero(mark[:-1] & (data[:-1] == 39) & run[1:] & (kind[1:] == _LETTER) & ~text_start[1:n])
    if len(lone):
        one = data[lone + 1]
        last = np.minimum(lone + 2, n - 1)
        two = np.where((lone + 2 < n) & ~text_start[lone + 2] & (kind[last] == _LETTER), data[last], 0)
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1,
                        np.where(((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)), 2, 0))
        lone, size = lone[size > 0], size[size > 0]
        mark[lone + 1] = False
        end = lone + 1 + size
        inside = end < n
        mark[end[inside]] = True  # the rest of the letters, or what starts there anyway
    return np.flatnonzero(mark)


def piece_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hashes of the matches."""
    if not len(start):
        return np.zeros(0, np.uint64)
    h = run_sums(_VALUE[data], start)
    h += np.diff(np.append(start, len(data))).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    return mix(h)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, place of the first of each, index of each value among them), by hashing."""
    coded = pa.array(h).dictionary_encode()
    index = coded.indices.to_numpy()
    top = np.maximum.accumulate(index) if len(index) else index
    first = np.flatnonzero(np.append(True, top[1:] > top[:-1])) if len(index) else np.zeros(0, np.int64)
    return coded.dictionary.to_numpy(), first, index
