"""Token-id files in Simple-8b blocks: 64-bit words of a 4-bit selector and 60 bits of ids.

Format.  A stream of ids is cut into blocks of ``BLOCK`` ids (the last may be shorter).  Each
block is packed on its own, greedily: a word takes the largest count of next ids that fit its
selector's width.  An id of ``2**60 - 1`` or more is an *escape*: a word of selector 15 with all
payload bits set, whose value is the next entry of the ``escapes`` list.  ``block_words`` holds
the word count of every block, so that blocks decode independently and all words of a file row
are decoded by a few array operations per selector.

Fixed values of the selectors (ids per word, bits per id)::

    0: 240 x 0   1: 120 x 0   2: 60 x 1   3: 30 x 2   4: 20 x 3   5: 15 x 4   6: 12 x 5   7: 10 x 6
    8: 8 x 7     9: 7 x 8    10: 6 x 10  11: 5 x 12  12: 4 x 15  13: 3 x 20  14: 2 x 30  15: 1 x 60

A file row (Parquet is the container) holds a run of whole documents in ascending id order:
``part`` and ``chunk`` (their order gives the order of documents), ``begin`` (ids of the part before the row), ``doc_id`` and
``n_tokens`` arrays, ``words``, ``block_words`` and ``escapes``.

Cases: a null or empty text has the end id alone; added tokens of the vocabulary that stand in a text become their ids, as
the library does by default; a null doc_id sorts before all others; equal
doc_ids are ordered by text (null first), so repeated rows give a defined order; an empty table gives an
empty file; other columns are ignored, whatever their names; a very long text fills as many blocks
as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.bpe import PieceCache
from ferrule.llm.words import slices

BLOCK = 1024
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = (1 << 60) - 1
FILE_SCHEMA = ("part int, chunk int, begin bigint, doc_id array<bigint>, n_tokens array<bigint>, words binary, "
               "block_words array<int>, escapes array<bigint>")


_SMALL_BITS = np.array([v.bit_length() for v in range(1 << 16)], dtype=np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value."""
    if len(values) and values.max() < 1 << 16:
        return _SMALL_BITS[values.astype(np.uint16)]
    out = np.zeros(len(values), dtype=np.uint8)
    for shift in (0, 16, 32, 48):
        part = (values >> np.uint64(shift)).astype(np.uint16) if shift else values.astype(np.uint16)
        if shift and not part.any():
            continue
        out = np.where(part > 0, _SMALL_BITS[part] + np.uint8(shift), out)
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words per block, escaped values) of a stream of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    filled = np.full(blocks, BLOCK, dtype=np.int64)
    filled[-1] = n - BLOCK * (blocks - 1)
    room = BLOCK + int(COUNT[0])  # zeros after a block: a word at its end may be part filled
    grid = np.zeros((blocks, room), dtype=np.uint64)
    bits = np.zeros((blocks, room), dtype=np.uint8)
    whole = n // BLOCK
    own_bits = np.minimum(_bits(values), np.uint8(60))
    own_bits[values >= np.uint64(ESCAPE)] = 60
    for to, source in ((grid, values), (bits, own_bits)):
        to[:whole, :BLOCK] = source[:whole * BLOCK].reshape(whole, BLOCK)
        if whole < blocks:
            to[whole, :n - whole * BLOCK] = source[whole * BLOCK:]
    # widest[p]: largest width among the next p ids, p a power of two
    widest = {1: bits.reshape(-1)}
    selector = np.full(blocks * room, 15, dtype=np.int8)
    for s in range(14, -1, -1):
        count = int(COUNT[s])
        power = 1 << (count.bit_length() - 1)
        while power not in widest:
            p = max(widest)
            widest[2 * p] = widest[p].copy()
            np.maximum(widest[p][:-p], widest[p][p:], out=widest[2 * p][:-p])
            if 2 * p > 8:
                del widest[p]
        over = widest[power]
        if count > power:
            over = over.copy()
            np.maximum(over[:power - count], widest[power][count - power:], out=over[:power - count])
        np.putmask(selector, over <= int(WIDTH[s]), np.int8(s))
    selector = selector.reshape(blocks, room)
    at = np.zeros(blocks, dtype=np.int64)
    active = np.arange(blocks)
    rows, places = [], []
    while len(active):
        here = at[active]
        rows.append(active)
        places.append(here)
        at[active] = here + COUNT[selector[active, here]]
        active = active[at[active] < filled[active]]
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    row, place = row[order], np.concatenate(places)[order]
    chosen = selector[row, place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    flat, base = grid.reshape(-1), row * room + place
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            payload = np.zeros(len(mine), dtype=np.uint64)
            for k in range(int(COUNT[s])):
                payload |= np.minimum(flat[base[mine] + k], np.uint64(ESCAPE)) << np.uint64(k * int(WIDTH[s]))
            words[mine] |= payload
    return words, np.bincount(row, minlength=blocks).astype(np.int32), values[values >= np.uint64(ESCAPE)]


def unpack(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a packed stream."""
    blocks = len(block_words)
    if not blocks:
        return np.zeros(0, np.uint64)
    room = BLOCK + int(COUNT[0])
    selector = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64(ESCAPE)
    count = COUNT[selector]
    first = np.concatenate(([0], np.cumsum(block_words.astype(np.int64))))[:-1]
    total = np.concatenate(([0], np.cumsum(count)))
    block = np.repeat(np.arange(blocks), block_words)
    place = total[:-1] - total[first][block] + block * room
    out = np.zeros(blocks * room, dtype=np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            mask = np.uint64((1 << int(WIDTH[s])) - 1)
            for k in range(int(COUNT[s])):
                # a part-filled last word writes zeros into the room after its block
                out[place[mine] + k] = (payload[mine] >> np.uint64(k * int(WIDTH[s]))) & mask
    if len(escapes):
        out[place[(selector == 15) & (payload == np.uint64(ESCAPE))]] = escapes
    return out.reshape(blocks, room)[:, :BLOCK].reshape(-1)[:n]


class LibraryEncoder:
    """Ids of the tokenizers library, for distinct matches of the split pattern only.

    The library's byte-level model encodes every match on its own, so the ids of a text are the ids
    of its matches in order; only matches not met lately are sent to the library.  Words with a
    space before them go many to a call: each starts at its space, which its first id shows.
    A text that holds the content of an added token (such as an end mark) goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        import public_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.added = [token.content for token in self.whole.get_added_tokens_decoder().values() if token.content]
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # a match of the pattern is never an added token of its text
        vocabulary = self.library.get_vocab()
        self.opens_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens_word[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.cache = PieceCache(public_tokenizers.PATTERN, self._encode_pieces)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the first id of each text (and the end)."""
        marked = np.zeros(len(column), dtype=bool)
        for content in self.added:
            marked |= pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self.cache.encode(column)
        ids, first = self.cache.encode(pc.if_else(pa.array(marked), pa.scalar("", column.type), column))
        parts = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        at = np.flatnonzero(marked)
        found = self.whole.encode_batch_fast(column.take(pa.array(at)).to_pylist(), add_special_tokens=False)
        for k, x in zip(at.tolist(), found, strict=True):
            parts[k] = np.array(x.ids, dtype="<u4")
        return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        missing = [p.decode() for p in pieces]
        out: dict[str, bytes] = {}
        words = [p for p in missing if p[0] == " " and p[1:].isalpha()]
        joined = ["".join(words[k:k + 200]) for k in range(0, len(words), 200)]
        ids = [x.ids for x in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.array(list(chain.from_iterable(ids)), dtype="<u4")
        bounds = np.append(np.flatnonzero(self.opens_word[flat]), len(flat)) * 4 if len(flat) else np.zeros(1, np.int64)
        raw, bounds = flat.tobytes(), bounds.tolist()
        out.update((w, raw[a:b]) for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True))
        others = [p for p in missing if p not in out]
        found = self.library.encode_batch_fast(others, add_special_tokens=False)
        out.update((p, np.array(x.ids, dtype="<u4").tobytes()) for p, x in zip(others, found, strict=True))
        return [out[p] for p in missing]


_ENCODERS: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, target: str, tokenizer: str, end_id: int = 0,
              doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending doc_id order.

    One range shuffle of the texts; each partition packs its documents in slices."""
    source = (docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
              .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        begin = 0
        for chunk, piece in enumerate(slices(batches)):
            ids, first = encoder.encode(piece.column("text"))
            words, block_words, escapes = pack(np.insert(ids, first[1:], end_id))
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([begin], pa.int64()),
                pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([np.diff(first) + 1], pa.list_(pa.int64())),
                pa.array([words.astype("<u8").tobytes()], pa.binary()),
                pa.array([block_words], pa.list_(pa.int32())),
                pa.array([escapes.astype(np.int64)], pa.list_(pa.int64()))],
                ["part", "chunk", "begin", "doc_id", "n_tokens", "words", "block_words", "escapes"])
            begin += len(ids) + piece.num_rows

    source.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").parquet(target)


def read_ids(spark: SparkSession, target: str) -> DataFrame:
    """Read the files back: per document ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids``
    (little-endian unsigned 32-bit).

    The ids before a part are a prefix sum of one total per part (as many as there were write tasks); the rest
    of a start is in the file row."""
    files = spark.read.schema(FILE_SCHEMA).parquet(target)
    sizes = files.select("part", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    totals = {r["part"]: r["n"] for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(totals):
        before[part] = at
        at += totals[part]
    parts = spark.createDataFrame(sorted(before.items()), "part int, part_start bigint")
    placed = files.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["n_tokens"], dtype=np.int64)
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["block_words"], dtype=np.int64),
                             np.array(row["escapes"], dtype=np.int64).astype(np.uint64), int(counts.sum()))
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(counts)
                each = [raw[4 * (e - c):4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_id"], pa.int64()), pa.array(row["start"] + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64()),
                    pa.array(each, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return placed.select("doc_id", "n_tokens", "words", "block_words", "escapes", "start").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
