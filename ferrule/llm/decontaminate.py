"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; the positions it leaves out may differ.  All masked
positions of the benchmark texts are hashed into a table, the same hashes of the corpus are
joined with it, and around each hit the two texts are compared token by token along the hit's
diagonal.  All maximal segments (+1 a match, -2 a substitution) of at least ``MIN_RUN`` matches are merged over the
diagonals of a (document, item) pair, so inserted or lost words only start another diagonal.  A pair is a leak when
its matched item tokens reach ``min(needed, ceil(share * item tokens))``.

Tokens are words with A-Z lower-cased and trailing ASCII punctuation ignored.  The benchmark side is broadcast
in blocks of about ``block_tokens`` tokens (items dealt by a hash of their row, the number of blocks from
their counted size), each joined with the whole corpus in one narrow pass.

Cases: null or empty texts have no tokens and never leak; items of fewer than ``SEED_WEIGHT`` tokens are matched by no
seed and never leak; a long text is compared whole; a null doc_id or item_id stays null; repeated rows
and equal ids give one row per (doc_id, item_id) with the largest overlap; equal items are reported each;
an empty table on either side gives no pairs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.rows import whole_row
from ferrule.llm.words import id_array, ids_of, mix, slices, words_of

#: Token offsets of the masks (fixed values).  Every segment of positive prefixes and suffixes with five matches holds one.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 4, 6, 7), (0, 2, 5, 6, 8), (0, 3, 4, 7, 9),
         (0, 1, 2, 4, 5))
SEED_WEIGHT = 5
MIN_RUN = 5
NEEDED = 13
SHARE = 0.6
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_FILTER_BITS = 22


def seed_hashes(tokens: np.ndarray, last: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of mask ``number`` at every token whose span ends before ``last`` (end of its text)."""
    mask = MASKS[number]
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, np.uint64(number + 1), dtype=np.uint64)
    for offset in mask:
        h *= _STEP
        h += tokens[offset:offset + n]
    at = np.flatnonzero(np.arange(n) + mask[-1] < last[:n])
    return mix(h[at]), at


class SeedTable:
    """Seeds of one block of benchmark texts."""

    def __init__(self, item_ids: list, texts: list[str]):
        words = words_of(pa.array(texts, pa.string()), fold=True)
        self.ids, self.first, self.tokens = item_ids, words.first, words.hash
        last = np.repeat(words.first[1:], np.diff(words.first))
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for number in range(len(MASKS)):
            h, at = seed_hashes(self.tokens, last, number)
            hashes.append(h)
            places.append(at)
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.hash, self.place = np.concatenate(hashes)[order], np.concatenate(places)[order]
        self.item = words.doc
        self.seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.seen[self.hash >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, words) -> np.ndarray:
        """Distinct (text, item, diagonal) triples of the seed hits of a slice."""
        last = np.repeat(words.first[1:], np.diff(words.first))
        found = [np.zeros((0, 2), np.int64)]
        for number in range(len(MASKS)):
            h, at = seed_hashes(words.hash, last, number)
            maybe = np.flatnonzero(self.seen[h >> np.uint64(64 - _FILTER_BITS)])
            h, at = h[maybe], at[maybe]
            begin, end = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            count = end - begin
            if count.sum():
                which = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                found.append(np.column_stack((np.repeat(at, count), self.place[which])))
        pairs = np.concatenate(found)
        doc = np.searchsorted(words.first, pairs[:, 0], "right") - 1
        item = self.item[pairs[:, 1]] if len(pairs) else pairs[:, 1]
        diagonal = (pairs[:, 0] - words.first[doc]) - (pairs[:, 1] - self.first[item])
        return np.unique(np.column_stack((doc, item, diagonal)), axis=0)


def best_runs(match: np.ndarray) -> np.ndarray:
    """Positions of the matches in all maximal scoring segments (+1 match, -2 otherwise) that hold at
    least ``MIN_RUN`` matches."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], match, [False])).astype(np.int8))).reshape(-1, 2)
    lengths = edge[:, 1] - edge[:, 0]
    before = np.cumsum(lengths) - lengths
    left = 3 * before - 2 * edge[:, 0]  # score up to each run of equal tokens
    kept: list[tuple[int, int]] = []
    segments: list[tuple[int, int, int, int]] = []
    least = None
    for low, high, begin, end in zip(left.tolist(), (left + lengths).tolist(), *edge.T.tolist(), strict=True):
        if least is None or low <= least:  # nothing before joins what follows
            kept += [x[2:] for x in segments]
            segments, least = [], low
        while True:
            at = len(segments) - 1
            while at >= 0 and segments[at][0] >= low:
                at -= 1
            if at < 0 or segments[at][1] >= high:
                break
            low, begin = segments[at][0], segments[at][2]
            del segments[at:]
        segments.append((low, high, begin, end))
    places = [np.flatnonzero(match[a:b]) + a for a, b in kept + [x[2:] for x in segments]]
    return np.concatenate([np.zeros(0, np.int64), *(x for x in places if len(x) >= MIN_RUN)])


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", needed: int = NEEDED, share: float = SHARE,
          block_tokens: int = 1_000_000) -> DataFrame:
    """One row per leaking (doc_id, item_id): ``matched`` item tokens, ``item_tokens`` and ``overlap`` (their ratio)."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = None
    for ids, texts in _blocks(benchmark, item_id, item_text, block_tokens):
        hits = source.mapInArrow(_scan(ids, texts, needed, share),
                                 "doc_id bigint, item_id bigint, matched bigint, item_tokens bigint")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.max("item_tokens").alias("item_tokens")
    ).withColumn("overlap", F.col("matched") / F.col("item_tokens"))


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_tokens: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the benchmark, block by block."""
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")
                             ).where(F.length("text") > 0)
    size = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_tokens))
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = mine.orderBy("item_id", "text").collect()  # bounded by block_tokens
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def _leaking(table: SeedTable, column: pa.Array, needed: int, share: float) -> list[tuple[int, int, int, int]]:
    """(text, item, matched, item tokens) of the leaks of a slice."""
    words = words_of(column, fold=True)
    matched: dict[tuple[int, int], set] = {}
    for doc, item, diagonal in table.hits(words).tolist():
        text = words.hash[words.first[doc]:words.first[doc + 1]]
        tokens = table.tokens[table.first[item]:table.first[item + 1]]
        low, high = max(0, -diagonal), min(len(tokens), len(text) - diagonal)
        places = best_runs(tokens[low:high] == text[low + diagonal:high + diagonal])
        matched.setdefault((doc, item), set()).update((places + low).tolist())
    sized = ((doc, item, len(places), int(table.first[item + 1] - table.first[item])) for (doc, item), places in matched.items())
    return [x for x in sized if x[2] and x[2] >= min(needed, int(np.ceil(share * x[3])))]


def _scan(item_ids: list, texts: list[str], needed: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SeedTable(item_ids, texts)
        for part in slices(batches):
            ids = ids_of(part.column("doc_id"))
            out = [(ids[doc], table.ids[item], matched, n)
                   for doc, item, matched, n in _leaking(table, part.column("text"), needed, share)]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [id_array(np.array(columns[0], np.int64)), *(pa.array(list(c), pa.int64()) for c in columns[1:])],
                ["doc_id", "item_id", "matched", "item_tokens"])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", needed: int = NEEDED, share: float = SHARE,
                  block_tokens: int = 1_000_000) -> DataFrame:
    """The rows whose text leaks no benchmark item, with all their columns; ids play no part."""
    kept = docs.select(whole_row(docs).alias("row"), F.col(text).cast("string").alias("text"))
    for ids, texts in _blocks(benchmark, item_id, item_text, block_tokens):
        kept = kept.mapInArrow(_clean(ids, texts, needed, share), kept.schema)
    return kept.select("row.*")


def _clean(item_ids: list, texts: list[str], needed: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SeedTable(item_ids, texts)
        for part in slices(batches):
            bad = {x[0] for x in _leaking(table, part.column("text"), needed, share)}
            yield part if not bad else part.take(pa.array([k for k in range(part.num_rows) if k not in bad], pa.int64()))

    return run
