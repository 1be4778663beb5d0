"""Document fingerprints from closed syncmers.

A k-mer of bytes is a *closed syncmer* when the smallest hash among its inner s-mers is that of its first or its last
s-mer.  The choice depends on the k-mer alone, not on its surroundings, so a passage keeps its anchors wherever it stands.
A fingerprint lists the hashes of all anchors of a text with their places, in the order of the text; texts with no anchor
have their own hash as the only one, and the empty text an empty fingerprint.

Two fingerprints are compared by the anchors that stand in the same order in both (longest common subsequence, repeated
anchors included), over the anchors of either (the larger count of each): 1 for equal texts.

The fingerprint string has 14 hexadecimal digits per anchor: 8 of the hash, 6 of the place in units of 16 bytes.

Cases: null is the empty text; two empty texts are alike (1), an empty and another are not (0); ids are ordered descending with
null first and equal ids by text; the only document of a table is its own next; an empty table gives an empty result; extra
columns are carried in ``row``; long texts are whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ferrule.llm.exchange import pack_batch, runs, unpack_batch
from ferrule.llm.rows import whole_row, with_fields
from ferrule.llm.words import ids_of, mix, slices, text_bytes

K, S = 20, 8
_INNER = K - S + 1
BUCKET_BYTES = 12 << 20
PAIR_COST = 3000  # cells of the bit-parallel table in the time of one pair of equal anchors
MASK_BYTES = 64 << 20


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the closed syncmers of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pair = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << np.uint16(8)
    four = pair[:-2].astype(np.uint32) | pair[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    inner = (eight ^ eight >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    inner = ((inner ^ inner >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32)
    least, span = inner, 1
    while 2 * span <= _INNER:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < _INNER:
        least = np.minimum(least[:span - _INNER], least[_INNER - span:])
    least = least[:n]
    chosen = np.flatnonzero((inner[:n] == least) | (inner[_INNER - 1:_INNER - 1 + n] == least))
    text = np.searchsorted(offsets, chosen, "right") - 1
    inside = chosen + K <= offsets[text + 1]
    chosen, text = chosen[inside], text[inside]
    middle, last = (K - S) // 2, K - S
    h = mix(eight[chosen] * np.uint64(0x9E3779B97F4A7C15) ^ mix(eight[chosen + middle]) * np.uint64(3)
            ^ mix(eight[chosen + last] + np.uint64(1)) * np.uint64(5))
    return text, chosen - offsets[text], h


def sketches(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fingerprint of every text: (32-bit anchor hashes, their places), in the order of the text."""
    data, offsets = text_bytes(column)
    text, place, h = anchors(data, offsets)
    h, place = h >> np.uint64(32), np.minimum(place >> 4, 0xFFFFFF)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for k in range(len(offsets) - 1):
        a, b = int(bounds[k]), int(bounds[k + 1])
        if a < b:
            out.append((h[a:b], place[a:b]))
        elif offsets[k] < offsets[k + 1]:
            digest = hashlib.blake2b(data[offsets[k]:offsets[k + 1]].tobytes(), digest_size=4).digest()
            out.append((np.frombuffer(digest, ">u4").astype(np.uint64), np.zeros(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def as_text(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    packed = (sketch[0] << np.uint64(24) | sketch[1].astype(np.uint64)).astype(">u8")
    return packed.view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays."""
    head = _alike(a, b)
    a, b = a[head:], b[head:]
    tail = _alike(a[::-1], b[::-1])
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    a = a[np.isin(a, b)]
    b = b[np.isin(b, a)]
    if not len(a):
        return head + tail
    names, code = np.unique(b, return_inverse=True)
    first = np.append(0, np.cumsum(np.bincount(code)))
    which = np.searchsorted(names, a)
    pairs = int((first[which + 1] - first[which]).sum())
    if pairs * PAIR_COST <= len(a) * len(b) or pairs <= len(a) + len(b):  # Hunt-Szymanski
        places = np.lexsort((-np.arange(len(b)), code)).tolist()
        chain: list[int] = []
        for low, high in zip(first[which].tolist(), first[which + 1].tolist(), strict=True):
            for q in places[low:high]:  # descending
                if not chain or q > chain[-1]:
                    chain.append(q)
                else:
                    chain[bisect_left(chain, q)] = q
        return head + tail + len(chain)
    full = (1 << len(b)) - 1
    masks: dict[int, int] = {}
    row = full
    for x in which.tolist():  # one bit of the row per place of b
        mask = masks.get(x)
        if mask is None:
            mask = int.from_bytes(np.packbits(code == x, bitorder="little").tobytes(), "little")
            if len(masks) * len(b) < 8 * MASK_BYTES:
                masks[x] = mask
        met = row & mask
        row = (row + met | row - met) & full
    return head + tail + len(b) - row.bit_count()


def likeness(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the anchors in the same order among the anchors of both."""
    if not len(one[0]) or not len(two[0]):
        return float(len(one[0]) == len(two[0]))
    (names, times), (others, other_times) = (np.unique(x[0], return_counts=True) for x in (one, two))
    at = np.minimum(np.searchsorted(others, names), len(others) - 1)
    common = int(np.minimum(times, other_times[at])[others[at] == names].sum())
    return in_order(one[0], two[0]) / (len(one[0]) + len(two[0]) - common) if common else 0.0


def fingerprints(docs: DataFrame, text: str = "text", carry: Column | None = None) -> DataFrame:
    """``row`` (``carry``, by default a struct of all columns) and ``fingerprint``; one narrow pass."""
    carry = whole_row(docs) if carry is None else carry
    source = docs.select(carry.alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [as_text(s) for s in sketches(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.string())], ["row", "fingerprint"])

    return source.mapInArrow(run, with_fields([source.schema["row"]], "fingerprint string"))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Column | None = None) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how alike they are.

    The next document (descending id) is found by ranges: the ids alone are range-partitioned, and each range's largest id
    becomes its bound.  Texts are sent once, packed, to their range; those with a bound's id also go to the range before
    it in the order.  Returns ``row``, ``n_chars``, ``edited`` (text), ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``."""
    carry = whole_row(docs) if carry is None else carry
    top = np.iinfo(np.int64).max
    source = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(top)).alias("doc_id"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), carry.alias("row"))
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(1, -(-size // BUCKET_BYTES))
    found = (source.select("doc_id").repartitionByRange(int(ranges), "doc_id").groupBy(F.spark_partition_id().alias("p"))
             .agg(F.max("doc_id").alias("bound")).collect())  # one row per range
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r["bound"] for r in found), dtype=np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = bounds.value
        for part in slices(batches, size=16 << 20):
            ids = ids_of(part.column("doc_id"))
            own = np.searchsorted(limit, ids, "left")
            edge = np.flatnonzero(limit[own] == ids)
            target = np.concatenate((own, (own[edge] + 1) % len(limit)))
            which = np.concatenate((np.arange(len(ids)), edge))
            guest = np.arange(len(which)) >= len(ids)
            order = np.lexsort((guest, target))
            out = []
            for key, a, b in runs(target[order] * 2 + guest[order]):
                out.append((key >> 1, bool(key & 1), pack_batch(part.take(pa.array(which[order[a:b]])))))
            for at in range(0, len(out), 64):
                columns = list(zip(*out[at:at + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1]),
                                                  pa.array(columns[2], pa.binary())], ["range", "guest", "payload"])

    row_type = to_arrow_type(source.schema["row"].dataType)

    def compare(table: pa.Table) -> pa.Table:
        sides: dict[bool, list] = {False: [], True: []}
        for guest, blob in zip(table.column("guest").to_pylist(), table.column("payload").to_pylist(), strict=True):
            sides[guest].append(unpack_batch(blob))
        own = pa.concat_tables(sides[False]).combine_chunks()
        own = own.sort_by([("doc_id", "descending"), ("text", "ascending")])
        texts = own.column("text").to_pylist()
        guests = pa.concat_tables(sides[True])
        following = texts[1:] + [min(zip([-x for x in guests.column("doc_id").to_pylist()],
                                         guests.column("text").to_pylist(), strict=True))[1]]
        result: list[list] = [[] for _ in range(6)]
        before = None  # fingerprint of the text after the slice is made with it
        for part in slices(iter(pa.table({"text": pa.array(texts + following[-1:], pa.string())}).combine_chunks().to_batches())):
            found = sketches(part.column("text"))
            if before is not None:
                found = [before] + found
            before = found[-1]
            base = len(result[0])
            changed = [edited(a, b) for a, b in zip(texts[base:base + len(found) - 1],
                                                    following[base:base + len(found) - 1], strict=True)]
            others = sketches(pa.array(changed, pa.string()))
            for k, (one, two) in enumerate(zip(found[:-1], others, strict=True)):
                values = (len(texts[base + k]), changed[k], as_text(one), as_text(two), likeness(one, two),
                          likeness(one, found[k + 1]))
                for column, value in zip(result, values, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.table([pa.chunked_array(own.column("row").chunks, row_type)]
                        + [pa.array(c, t) for c, t in zip(result, kinds, strict=True)],
                        ["row", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return source.mapInArrow(deal, "range int, guest boolean, payload binary").groupBy("range").applyInArrow(
        compare, with_fields([source.schema["row"]], "n_chars bigint, edited string, fingerprint string, "
                                                     "edited_fingerprint string, near_edited double, near_next double"))
