"""Substring dedup by prefix-partitioned suffix trees over words.

Every word position that has ``window`` words after it in its document starts a suffix.  Its *path* is a
bit string: six bits for each of its first two words, then the digest of its first
``window`` words.  The suffixes are split by **variable-length prefixes** of that path: the corpus
is counted by the first two words; a cell of more than ``group_size`` suffixes is split by as many
further bits as bring its parts under that size, and small neighbouring cells share a group.  So every group is
one or a few subtrees of the suffix tree and fits a task's memory.

In its group a subtree is built down to depth ``window``: its leaves, sorted by path, fall into
runs, and a run is an internal node of that depth.  A node whose leaves lie in more than one
document is a repeat; nothing above it matters for a minimum length of ``window`` words, and the
levels below it are the overlapping nodes of the next word positions, so **maximal repeats** come
out as the unions of consecutive marked windows of a document (``spans``).  In a node the leaves of
the smallest doc_id stay; each word under a leaf of another document is removed.

The suffixes travel as packed arrays (about nine bytes each).  Equal windows inside a slice of a task are
combined first: only the smallest document of the slice competes, the others are known repeats and
are spread over all groups, so a passage in a third of all documents does not load one group.
Paths are 64-bit digests: among n windows about n**2 / 2**65 pairs are mistaken for equal.

Rows meet their marks in buckets of about ``bucket_words`` six-byte words, counted in bytes of whole rows plus a fixed
part per row, so texts without windows count too.  Ids are dealt by a hash; where a cell of it is larger than
a bucket (many rows of a null or repeated id) its rows are dealt by their texts as well and a mark goes to the
text's own bucket; what equal texts of one id still overfill is dealt by turns, with the bucket's marks sent to each turn.

Cases: a null or empty text has no words; a document shorter than ``window`` keeps all; a null
doc_id counts as larger than any other; rows with the same doc_id count as one document, so none of them
removes the other's words; repeats inside one document stay; an empty table gives an empty result;
other columns are carried in ``row`` untouched, whatever their names; long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ferrule.llm.exchange import expand, from_gaps, gaps, packed_by_bucket, runs, squeeze, totals, unpack_batch
from ferrule.llm.rows import whole_row, with_fields
from ferrule.llm.words import cut, freeing, give_back, ids_of, mix, slices, text_bytes, window_hashes, words_of

WORD_BITS = 6
CELLS = 1 << (2 * WORD_BITS)
GROUP_SIZE = 2_000_000
DEAL_BITS = 14
WORD_BYTES, ROW_BYTES = 6, 256  # of a word with its blank; of a row beside its columns


def _suffixes(column: pa.Array, window: int) -> tuple:
    """(words, path digest, index of the first word, cell) of the suffixes of a slice."""
    words = words_of(column)
    path, at = window_hashes(words, window)
    code = (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return words, path, at, code[at] << WORD_BITS | code[at + (1 if window > 1 else 0)]


def plan_groups(counts: np.ndarray, group_size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group, extra prefix bits) of every cell, and the number of groups."""
    first, bits = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    group, room = -1, 0
    for cell, n in enumerate(counts.tolist()):
        if n > group_size:
            bits[cell] = int(-(-n // group_size) - 1).bit_length()
            first[cell] = group + 1
            group += 1 << int(bits[cell])
            room = 0
        else:
            if group < 0 or n > room:
                group, room = group + 1, group_size
            first[cell] = group
            room -= n
    return first, bits, group + 1


def _cells_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) >> np.uint64(64 - DEAL_BITS)).astype(np.int64)


def _weights(part: pa.RecordBatch) -> np.ndarray:
    """Bytes of every row of a slice: its text, the other columns on average, and a fixed part."""
    own = np.diff(text_bytes(part.column("text"))[1])
    more = sum(c.nbytes for name, c in zip(part.schema.names, part.columns, strict=True) if name != "text") - own.sum()
    return own + max(0, int(more)) // len(own) + ROW_BYTES


@dataclass
class Deal:
    """Which bucket holds a row: ``first`` bucket and extra bits by cell of the id; buckets of equal texts have several
    turns from ``turn`` on."""

    first: np.ndarray
    bits: np.ndarray
    turns: np.ndarray

    @property
    def turn(self) -> np.ndarray:
        return np.cumsum(self.turns) - self.turns

    def chunks(self, ids: np.ndarray, column: pa.Array) -> np.ndarray:
        """Number of each text among the buckets of its cell; 0 where a cell has one bucket."""
        bits = self.bits[_cells_of(ids)]
        out = np.zeros(len(ids), np.int64)
        split = np.flatnonzero(bits)
        if len(split):
            data, offsets = text_bytes(column)
            digest = [crc32(data[a:b]) for a, b in zip(offsets[split].tolist(), offsets[split + 1].tolist(), strict=True)]
            out[split] = np.array(digest, np.int64) & ((1 << bits[split]) - 1)
        return out

    def buckets(self, ids: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        return self.first[_cells_of(ids)] + chunks

    def keys(self, part: pa.RecordBatch) -> np.ndarray:
        """Bucket and turn of every row as one number."""
        ids = ids_of(part.column("doc_id"))
        bucket = self.buckets(ids, self.chunks(ids, part.column("text")))
        context = TaskContext.get()
        start = mix(np.array([context.partitionId() if context else 0], np.uint64))[0] >> np.uint64(1)
        return self.turn[bucket] + (np.arange(len(ids)) + int(start)) % self.turns[bucket]


def plan(source: DataFrame, window: int, bucket_bytes: int) -> tuple[np.ndarray, Deal]:
    """Suffixes by cell of their first words, and how the rows of ``source(doc_id, text, ...)`` are dealt."""

    def count(part: pa.RecordBatch) -> np.ndarray:
        weights = np.bincount(_cells_of(ids_of(part.column("doc_id"))), _weights(part), 1 << DEAL_BITS)
        cells = np.bincount(_suffixes(part.column("text"), window)[3], minlength=CELLS)
        return np.concatenate((cells, weights.astype(np.int64)))

    counted = totals(source, count, CELLS + (1 << DEAL_BITS))
    first, bits, buckets = plan_groups(counted[CELLS:], bucket_bytes)
    deal = Deal(first, bits, np.ones(buckets, np.int64))
    if bits.any():

        def held(part: pa.RecordBatch) -> np.ndarray:
            ids = ids_of(part.column("doc_id"))
            bucket = deal.buckets(ids, deal.chunks(ids, part.column("text")))
            return np.bincount(bucket, _weights(part), buckets).astype(np.int64)

        deal = Deal(first, bits, np.maximum(1, -(-totals(source, held, buckets) // (2 * bucket_bytes))))
    return counted[:CELLS], deal


def repeated_windows(docs: DataFrame, window: int, group_size: int, counts: np.ndarray, deal: Deal) -> DataFrame:
    """Packed (document, path) pairs of every window that also starts in a smaller document, by
    bucket and turn of the document's texts."""
    first_group, bits, n_groups = plan_groups(counts, group_size)
    n_groups = max(1, n_groups)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(slices(batches, size=8 << 20)):
            ids = ids_of(part.column("doc_id"))
            names, owner_of = np.unique(ids, return_inverse=True)
            chunk = deal.chunks(ids, part.column("text"))
            chunks = int(chunk.max()) + 1
            pairs, slot_of = np.unique(owner_of * chunks + chunk, return_inverse=True)
            owner = pairs // chunks  # a slot is an id and a chunk of its texts, in the order of ids
            doc, path, cell = [], [], []
            base = 0
            for piece in cut(part):  # kernels work on smaller arrays
                words, h, at, c = _suffixes(piece.column("text"), window)
                doc.append(slot_of[base + words.doc[at]].astype(np.int32))
                path.append(h)
                cell.append(c.astype(np.int32))
                base += piece.num_rows
            del words, h, at, c
            give_back()  # the kernels' work space, before arrays of the whole slice
            doc, path, cell = np.concatenate(doc), np.concatenate(path), np.concatenate(cell)
            if not len(path):
                continue
            ordered = np.sort(path)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            del ordered
            compete = np.ones(len(path), dtype=bool)
            known = np.zeros(len(path), dtype=bool)
            if len(twice):
                place = np.minimum(np.searchsorted(twice, path), len(twice) - 1)
                several = np.flatnonzero(twice[place] == path)
                several = several[np.lexsort((doc[several], place[several]))]
                node, slot = place[several], doc[several]
                head = np.append(True, node[1:] != node[:-1])
                lowest = slot[np.maximum.accumulate(np.where(head, np.arange(len(node)), 0))]
                again = np.append(False, (node[1:] == node[:-1]) & (slot[1:] == slot[:-1]))
                least = owner[slot] == owner[lowest]
                compete[several] = least & ~again
                known[several] = ~least & ~again
                del place, several, node, slot, head, lowest, again, least
            group = first_group[cell]
            split = bits[cell]
            deep = split > 0
            if deep.any():
                group[deep] += (path[deep] >> (np.uint64(64) - split[deep].astype(np.uint64))).astype(np.int64)
            packed_ids, packed_chunks = squeeze(names[owner]), squeeze(pairs % chunks)
            out = []
            for kind, chosen in ((0, np.flatnonzero(compete)), (1, np.flatnonzero(known))):
                # known repeats go to any group, by document
                to = group[chosen] if kind == 0 else (doc[chosen] + number) % n_groups
                order = np.lexsort((doc[chosen], to)) if n_groups >= 1 << 16 or kind else _by_group(doc[chosen], to)
                chosen = chosen[order]
                for g, a, b in runs(to[order]):
                    slots, width = gaps(doc[chosen[a:b]])
                    out.append((g, kind, packed_ids, packed_chunks, slots, width, path[chosen[a:b]].tobytes()))
            for at in range(0, len(out), 64):
                columns = list(zip(*out[at:at + 64], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int8()), pa.array(columns[2], pa.binary()),
                     pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.int8()),
                     pa.array(columns[6], pa.binary())],
                    ["grp", "kind", "ids", "chunks", "slots", "width", "paths"])

    def subtrees(table: pa.Table) -> pa.Table:
        doc: dict[int, list] = {0: [], 1: []}
        chunk: dict[int, list] = {0: [], 1: []}
        path: dict[int, list] = {0: [], 1: []}
        for batch in table.to_batches():
            for row in batch.to_pylist():
                slots = from_gaps(row["slots"], row["width"])
                doc[row["kind"]].append(expand(row["ids"])[slots])
                chunk[row["kind"]].append(expand(row["chunks"]).astype(np.int32)[slots])
                path[row["kind"]].append(np.frombuffer(row["paths"], np.uint64))
        repeat_doc, repeat_chunk, repeat_path = doc[1], chunk[1], path[1]
        if doc[0]:
            d, c, p = np.concatenate(doc.pop(0)), np.concatenate(chunk.pop(0)), np.concatenate(path.pop(0))
            ordered = np.sort(p)
            deep = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])  # nodes with two leaves or more
            if len(deep):
                node = np.minimum(np.searchsorted(deep, p), len(deep) - 1)
                leaves = np.flatnonzero(deep[node] == p)
                node, d, c = node[leaves], d[leaves], c[leaves]
                lowest = np.full(len(deep), np.iinfo(np.int64).max)
                np.minimum.at(lowest, node, d)
                later = d > lowest[node]
                repeat_doc.append(d[later])
                repeat_chunk.append(c[later])
                repeat_path.append(deep[node[later]])
        if not repeat_doc:
            return pa.table({"bucket": pa.array([], pa.int32()), "docs": pa.array([], pa.binary()),
                             "paths": pa.array([], pa.binary())})
        d, p = np.concatenate(repeat_doc), np.concatenate(repeat_path)
        bucket = deal.buckets(d, np.concatenate(repeat_chunk))
        order = np.lexsort((d, bucket))
        d, p = d[order], p[order]
        turn, keys, docs_of, paths_of = deal.turn, [], [], []
        for k, a, b in runs(bucket[order]):
            times = int(deal.turns[k])
            keys += range(int(turn[k]), int(turn[k]) + times)
            docs_of += [squeeze(d[a:b])] * times
            paths_of += [p[a:b].tobytes()] * times
        return pa.table({"bucket": pa.array(keys, pa.int32()), "docs": pa.array(docs_of, pa.binary()),
                         "paths": pa.array(paths_of, pa.binary())})

    routed = docs.select("doc_id", "text").mapInArrow(
        route, "grp int, kind tinyint, ids binary, chunks binary, slots binary, width tinyint, paths binary")
    return routed.groupBy("grp").applyInArrow(freeing(subtrees), "bucket int, docs binary, paths binary")


def _by_group(doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order by (group, document) from two stable passes over 16-bit keys where they fit."""
    order = np.argsort(doc.astype(np.uint16) if not len(doc) or doc.max() < 1 << 16 else doc, kind="stable")
    return order[np.argsort(group[order].astype(np.uint16), kind="stable")]


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text",
                   carry: Column | None = None, group_size: int = GROUP_SIZE,
                   bucket_words: int = 1_500_000) -> DataFrame:
    """Remove every word under a window of ``window`` words that also starts in a document of smaller id.

    Returns ``row`` (``carry``, by default a struct of all columns), ``n_words``, ``n_removed``, ``kept_text`` (the kept
    words joined by one space) and ``spans`` (word ranges ``[begin, end)`` of the maximal repeats removed).
    """
    carry = whole_row(docs) if carry is None else carry
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
                         carry.alias("row"))
    counts, deal = plan(source, window, bucket_words * WORD_BYTES)
    found = repeated_windows(source.select("doc_id", "text"), window, group_size, counts, deal)
    row_type = to_arrow_type(source.schema["row"].dataType)

    def removed_words(left: pa.Table, right: pa.Table) -> pa.Table:
        marks = [np.zeros(0, np.uint64)]
        marked_docs = [np.zeros(0, np.int64)]
        for blob, paths in zip(right.column("docs").to_pylist(), right.column("paths").to_pylist(), strict=True):
            d = expand(blob)
            marked_docs.append(np.unique(d))
            marks.append(np.frombuffer(paths, np.uint64) ^ mix(d.astype(np.uint64)))
        marks = np.unique(np.concatenate(marks))
        marked_docs = np.unique(np.concatenate(marked_docs))
        out: dict[str, list] = {"row": [], "n_words": [], "n_removed": [], "kept_text": [], "spans": []}
        for blob in left.column("payload").to_pylist():
            for part in chain.from_iterable(map(cut, unpack_batch(blob).to_batches())):
                ids = ids_of(part.column("doc_id"))
                hit = np.isin(ids, marked_docs)
                out["row"].append(part.column("row"))
                words = words_of(part.column("text"))
                gone = np.zeros(len(words.start) + 1, dtype=np.int64)
                if hit.any():
                    path, at = window_hashes(words, window)
                    doc = words.doc[at]
                    inside = hit[doc]
                    path, at, doc = path[inside], at[inside], doc[inside]
                    key_of = path ^ mix(ids[doc].astype(np.uint64))
                    place = np.minimum(np.searchsorted(marks, key_of), len(marks) - 1)
                    at = at[marks[place] == key_of]
                    np.add.at(gone, at, 1)
                    np.subtract.at(gone, at + window, 1)
                removed = np.cumsum(gone[:-1]) > 0
                for k, t in enumerate(part.column("text").to_pylist()):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    own = (t or "").encode().split()
                    mask = removed[a:b]
                    out["n_words"].append(b - a)
                    out["n_removed"].append(int(mask.sum()))
                    out["kept_text"].append(b" ".join(compress(own, (~mask).tolist()) if mask.any() else own).decode())
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                    out["spans"].append([{"begin": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
        rows = pa.chunked_array(out["row"]) if out["row"] else pa.chunked_array([], row_type)
        return pa.table({"row": rows, "n_words": pa.array(out["n_words"], pa.int64()),
                         "n_removed": pa.array(out["n_removed"], pa.int64()),
                         "kept_text": pa.array(out["kept_text"], pa.string()),
                         "spans": pa.array(out["spans"], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))})

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = removed_words(left, right)
        give_back()
        return out

    left = packed_by_bucket(source, deal.keys).groupBy("bucket")
    return left.cogroup(found.groupBy("bucket")).applyInArrow(
        remove, with_fields([source.schema["row"]], "n_words bigint, n_removed bigint, kept_text string, "
                                                 "spans array<struct<begin: bigint, end: bigint>>"))
