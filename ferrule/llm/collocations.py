"""Phrase collocations by SON partitioning: mine shards at lowered support, unite, count exactly.

1. *Chunks.*  Every task cuts its texts into chunks of one language and about ``CHUNK_BYTES`` of text,
   words as codes of the chunk's own dictionary, and writes them as rows of one table.  A very
   long text is cut behind a piece separator, so no phrase is lost and memory does not grow with it.
   The chunks are dealt to a fixed number of *shards*, which many tasks mine together.
2. *Local mining.*  A shard with ``n_i`` of a language's ``n`` words is mined completely at the support
   ``t_i = ceil(support * n_i / n)``.  A phrase below ``t_i`` in every shard has fewer than ``support``
   occurrences, so the union of the locally frequent phrases lacks none.
3. *Union.*  A shard that does not report a phrase holds at most ``t_i - 1`` of it.  A phrase whose reported
   counts and these bounds together stay below the support is dropped; what is left are the candidates.
4. *Counting.*  Another pass counts all candidates over all chunks, by their text.

With shards of one task's size the local support would fall to 1 as the corpus grows; with a fixed number of shards, each
counted in groups of hash ranges, it is the same at every size.

The union is kept as a bitmap of fixed size over phrase hashes: a hash or bitmap clash can only add
a candidate, which the exact count then drops.  Mining goes level by level: every part of a frequent phrase is
frequent, so only phrases are looked at whose shorter parts are candidates.

Cases: a null text counts as empty, a null language as ``und``; an empty table gives an empty result;
repeated rows count as often as they occur; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.exchange import pack_batch, unpack_batch
from ferrule.llm.words import mix, text_bytes
from ferrule.session import cut_lineage

CHUNK_BYTES = 6 << 20
SHARDS = 8
BITMAP_BITS = 1 << 26  # 8 MB; clashes cost work, never rows
LONGEST = 4
HASH_BITS = 48          # of a phrase's hash in the union; more than the bitmap looks at
WAITING = 2_000_000     # phrases a task holds before it deals them

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _STOP.copy()
_GAP[[0x20, 0x09]] = True


# --- chunks -----------------------------------------------------------------------

def _segments(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and text index of segments: whole texts, those over ``size`` bytes cut behind a piece separator."""
    begin, owner = [offsets[:-1]], [np.arange(len(offsets) - 1)]
    for i in np.flatnonzero(np.diff(offsets) > size).tolist():
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > size:
            after = at + size
            while after < end:  # the first separator from there on
                found = np.flatnonzero(_STOP[data[after:min(after + (1 << 16), end)]])
                if len(found):
                    after += int(found[0]) + 1
                    break
                after = min(after + (1 << 16), end)
            if after >= end:
                break
            begin.append(np.array([after]))
            owner.append(np.array([i]))
            at = after
    begin, owner = np.concatenate(begin), np.concatenate(owner)
    order = np.lexsort((begin, owner))
    return begin[order], owner[order]


def _tokens(data: np.ndarray, begin: np.ndarray, end: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of consecutive segments of ``data`` up to ``end``: their text, segment, and
    whether each opens a piece."""
    low = int(begin[0])
    part = _LOWER[data[low:end]]
    gap = _GAP[part]
    edge = np.zeros(len(part) + 1, dtype=bool)
    inner = begin[(begin > low) & (begin < end)] - low
    edge[inner] = True
    edge[0] = edge[-1] = True
    is_word = ~gap
    start = np.flatnonzero(is_word & (edge[:-1] | np.append(True, gap[:-1])))
    stop = np.flatnonzero(is_word & (edge[1:] | np.append(gap[1:], True))) + 1
    pieces = np.searchsorted(np.flatnonzero(_STOP[part]), start)
    segment = np.searchsorted(begin - low, start, "right") - 1
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = (pieces[1:] != pieces[:-1]) | (segment[1:] != segment[:-1])
    lengths = np.concatenate(([0], np.cumsum(stop - start)))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [
        None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(part[is_word]))])
    return words, segment, opens


def chunks(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` as rows ``(lang, shard, n_words, words, places)``: a chunk's distinct words, and
    their codes in order with marks where a piece begins."""
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                         F.col(text).cast("string").alias("text")).where(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column("lang").dictionary_encode()
            names, lang_of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            data, offsets = text_bytes(batch.column("text"))
            begin, owner = _segments(data, offsets, size)
            ends = np.append(begin[1:], len(data))
            at = 0
            while at < len(begin):
                to = max(int(np.searchsorted(ends, begin[at] + size, "right")), at + 1)
                words, segment, opens = _tokens(data, begin[at:to], int(ends[to - 1]))
                coded = words.dictionary_encode()
                codes, known = coded.indices.to_numpy(), coded.dictionary
                of_lang = lang_of[owner[at:to]][segment]
                for k in np.unique(of_lang).tolist():
                    mine = of_lang == k
                    used, code = np.unique(codes[mine], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([names[k]], pa.string()), pa.array([shard], pa.int32()), pa.array([len(code)], pa.int64()),
                        pa.array([pack_batch(pa.record_batch([known.take(pa.array(used))], ["word"]))], pa.binary()),
                        pa.array([pack_batch(pa.record_batch(
                            [pa.array(code.astype(np.int32)), pa.array(opens[mine])], ["code", "opens"]))], pa.binary())],
                        ["lang", "shard", "n_words", "words", "places"])
                at = to

    return source.mapInArrow(run, "lang string, shard int, n_words bigint, words binary, places binary")


class Chunk:
    """One chunk row: distinct words with their hashes, the code of every place, and where pieces open."""

    def __init__(self, row: dict):
        self.lang = row["lang"]
        self.words = unpack_batch(row["words"]).column("word").combine_chunks()
        places = unpack_batch(row["places"])
        self.code = places.column("code").to_numpy().astype(np.int64)
        self.opens = places.column("opens").to_numpy()

    def hashes(self) -> np.ndarray:
        """Equal to Spark's ``xxhash64(lang, word)``."""
        seed = xxhash.xxh64_intdigest(self.lang.encode(), seed=42)
        digest = xxhash.xxh64_intdigest
        return np.array([digest(w, seed=seed) for w in self.words.to_pylist()], dtype=np.uint64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def word_counts(cut: DataFrame) -> DataFrame:
    """``(lang, word, f)`` of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            count = np.bincount(chunk.code, minlength=len(chunk.words))
            for at in range(0, len(chunk.words), 1 << 16):
                part = chunk.words.slice(at, 1 << 16)
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk.lang] * len(part), pa.string()), part.cast(pa.binary()).cast(pa.string()),
                    pa.array(count[at:at + (1 << 16)], pa.int64())], ["lang", "word", "f"])

    return (cut.select("lang", "words", "places").mapInArrow(run, "lang string, word string, f bigint")
            .groupBy("lang", "word").agg(F.sum("f").alias("f")))


# --- bitmaps ------------------------------------------------------------------------

def bitmap(hashes: DataFrame, column: str = "hash", bits: int = BITMAP_BITS) -> np.ndarray:
    """Bytes of a bitmap of ``bits`` bits (a power of two) over the low bits of the hashes."""
    place = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    rows = (hashes.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")).collect())
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows:
        part = np.frombuffer(row["bitmap"], np.uint8)
        at = (row["bucket"] - 1) * len(part)
        out[at:at + len(part)] = part[:max(0, len(out) - at)]
    return out


def _marked(bitmap_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64(len(bitmap_bytes) * 8 - 1)
    return (bitmap_bytes[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


# --- levels of one chunk ----------------------------------------------------------------

class Level:
    """The distinct phrases of one length in a chunk.  ``first`` holds a place of each, ``count`` its
    occurrences, ``hash`` its hash; ``at`` the phrase that begins at each place of the chunk, or -1."""

    def __init__(self, at: np.ndarray, first: np.ndarray, count: np.ndarray, hashes: np.ndarray):
        self.at, self.first, self.count, self.hash = at, first, count, hashes

    def keep(self, chosen: np.ndarray) -> Level:
        """Only the chosen phrases, numbered anew."""
        number = np.full(len(chosen) + 1, -1, dtype=np.int64)
        number[:-1][chosen] = np.arange(int(chosen.sum()))
        return Level(number[self.at], self.first[chosen], self.count[chosen], self.hash[chosen])


def first_level(chunk: Chunk) -> Level:
    count = np.bincount(chunk.code, minlength=len(chunk.words))
    first = np.zeros(len(chunk.words), dtype=np.int64)
    first[chunk.code[::-1]] = np.arange(len(chunk.code) - 1, -1, -1)
    return Level(chunk.code, first, count, chunk.hashes())


def next_level(chunk: Chunk, words: Level, level: Level, length: int) -> Level:
    """Phrases of ``length`` words whose first and last ``length - 1`` words are in ``level``."""
    n = len(chunk.code)
    place = np.flatnonzero(level.at[:max(0, n - length + 1)] >= 0)
    place = place[(level.at[place + 1] >= 0) & ~chunk.opens[place + length - 1]]
    last = words.at[place + length - 1]
    pair = level.at[place] * (len(words.first) + 1) + last
    _, index, inverse, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
    at = np.full(n, -1, dtype=np.int64)
    at[place] = inverse
    first = place[index]
    hashes = mix(level.hash[level.at[first]] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(length)
                 + words.hash[words.at[first + length - 1]])
    return Level(at, first, count, hashes)


# --- mining and counting -------------------------------------------------------------------

def with_support(cut: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """Chunks with ``what``, which packs their shard, its local support ``t`` and what a phrase's excess over the local
    supports must reach (``need``); and ``(lang, n, need)`` per language."""
    shards = cut_lineage(cut.groupBy("lang", "shard").agg(F.sum("n_words").alias("n_i")))
    totals = shards.groupBy("lang").agg(F.sum("n_i").alias("n"))
    share = F.ceil((F.lit(support) * F.col("n_i").cast("decimal(38,0)")) / F.col("n")).cast("bigint")
    local = shards.join(totals, "lang").select("lang", "shard", "n", F.greatest(share, F.lit(1)).alias("t"))
    langs = cut_lineage(local.groupBy("lang").agg(F.max("n").alias("n"), (F.lit(support) - F.sum(F.col("t") - 1)).alias("need")))
    packed = F.shiftleft("t", 36) + F.shiftleft("need", 8) + F.col("shard")
    # tables of known size: joined by broadcast only where they are small
    what = cut_lineage(local.join(langs.select("lang", "need"), "lang").select("lang", "shard", packed.alias("what")))
    return cut.join(what, ["lang", "shard"]), langs


def _shrink(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the sums of their counts."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(values: np.ndarray) -> bytes:
    """Compressed bytes of integers, all first bytes first, then all second bytes, and so on."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _from_planes(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).reshape(-1).view("<u8")


def _packed(hashes: np.ndarray, counts: np.ndarray, what: int, ranges: int) -> pa.RecordBatch:
    """Distinct hashes as one row per range of hashes: their differences and counts."""
    part = (hashes * np.uint64(ranges)) >> np.uint64(HASH_BITS)
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    end = np.append(begin[1:], len(part))
    rows = list(zip(begin.tolist(), end.tolist(), strict=True))
    return pa.RecordBatch.from_arrays([
        pa.array(part[begin].astype(np.int32)), pa.array(np.full(len(rows), what, dtype=np.int64)), pa.array(end - begin),
        pa.array([_planes(np.diff(hashes[x:y], prepend=np.uint64(0))) for x, y in rows], pa.binary()),
        pa.array([_planes(counts[x:y]) for x, y in rows], pa.binary())], ["part", "what", "n", "hashes", "counts"])


def _locally_frequent(rows: pa.Table) -> pa.Table:
    """The union over shards within one range: hashes whose reported counts and bounds reach the support."""
    hashes, counts, whats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in rows.to_batches(max_chunksize=64):
        for what, n, h, c in zip(*[row.column(k).to_pylist() for k in ("what", "n", "hashes", "counts")], strict=True):
            hashes.append(np.cumsum(_from_planes(h, n)))
            counts.append(_from_planes(c, n).astype(np.int64))
            whats.append(np.full(n, what, dtype=np.int64))
    hashes, counts, whats = np.concatenate(hashes), np.concatenate(counts), np.concatenate(whats)
    order = np.lexsort((whats, hashes))
    hashes, counts, whats = hashes[order], counts[order], whats[order]
    if len(hashes):
        first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (whats[1:] != whats[:-1])))
        hashes, whats, counts = hashes[first], whats[first], np.add.reduceat(counts, first)
        t, need = whats >> 36, (whats >> 8) & ((1 << 28) - 1)
        local = counts >= t
        hashes, need, excess = hashes[local], need[local], (counts - t + 1)[local]
    if len(hashes):
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        hashes = hashes[first][np.add.reduceat(excess, first) >= need[first]]
    return pa.table([pa.array(hashes.astype(np.int64))], ["hash"])


def mine(cut: DataFrame, frequent_words: np.ndarray, known: dict[int, np.ndarray]) -> DataFrame:
    """Hashes of the candidates one word longer than those of ``known`` (bitmaps by length; none yet: pairs).

    A task sums the counts of its chunks per shard and deals them, packed by ranges of the hash (four to a shuffle partition), so
    a packed row never holds less than one phrase.  The sums of a shard that are frequent in it go into the union with their
    excess over ``t - 1``."""
    held = cut.sparkSession.sparkContext.broadcast((frequent_words, known))
    ranges = min(4 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 15)
    low = np.uint64((1 << HASH_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, shorter = held.value
        waiting: dict[int, list] = {}
        size = 0
        for row in _rows(batches):
            chunk = Chunk(row)
            words = first_level(chunk)
            words = level = words.keep(_marked(known_words, words.hash))
            for length in range(2, len(shorter) + 3):
                level = next_level(chunk, words, level, length)
                if length in shorter:
                    level = level.keep(_marked(shorter[length], level.hash))
            waiting.setdefault(row["what"], []).append((level.hash & low, level.count))
            size += len(level.hash)
            if size > WAITING:
                yield from _flush(waiting, ranges)
                waiting, size = {}, 0
        yield from _flush(waiting, ranges)

    packed = cut.select("lang", "words", "places", "what").mapInArrow(
        run, "part int, what bigint, n bigint, hashes binary, counts binary")
    return packed.groupBy("part").applyInArrow(_locally_frequent, "hash bigint")


def _flush(waiting: dict[int, list], ranges: int) -> Iterator[pa.RecordBatch]:
    for what, parts in waiting.items():
        hashes, counts = _shrink(np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]))
        if len(hashes):
            yield _packed(hashes, counts, what, ranges)


def count_phrases(cut: DataFrame, frequent_words: np.ndarray, candidates: dict[int, np.ndarray], support: int) -> DataFrame:
    """``(lang, phrase, f)`` of all candidates with ``support`` occurrences, counted by their text."""
    held = cut.sparkSession.sparkContext.broadcast((frequent_words, candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, known = held.value
        for row in _rows(batches):
            chunk = Chunk(row)
            words = first_level(chunk)
            words = words.keep(_marked(known_words, words.hash))
            level, texts = words, chunk.words
            for length in range(2, LONGEST + 1):
                level = next_level(chunk, words, level, length)
                level = level.keep(_marked(known[length], level.hash))
                for at in range(0, len(level.hash), 1 << 16):
                    first = level.first[at:at + (1 << 16)]
                    parts = [texts.take(pa.array(chunk.code[first + k])) for k in range(length)]
                    joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([chunk.lang] * len(first), pa.string()), joined.cast(pa.binary()).cast(pa.string()),
                        pa.array(level.count[at:at + (1 << 16)], pa.int64())], ["lang", "phrase", "f"])

    return (cut.select("lang", "words", "places").mapInArrow(run, "lang string, phrase string, f bigint")
            .groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= support))


def frequent_phrases(docs: DataFrame, support: int = 30, lang: str = "lang", text: str = "text",
                     size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Every phrase of 1 to 4 words with ``support`` occurrences, ``(lang, phrase, f)``, and the
    word total ``(lang, n)`` of every language."""
    cut = cut_lineage(chunks(docs, lang, text, size))
    words = cut_lineage(word_counts(cut).where(F.col("f") >= support))
    marked_words = bitmap(words.select(F.xxhash64("lang", "word").alias("hash")))
    supported, langs = with_support(cut, support)
    candidates: dict[int, np.ndarray] = {}
    for length in range(2, LONGEST + 1):
        candidates[length] = bitmap(mine(supported, marked_words, candidates))
    phrases = count_phrases(cut, marked_words, candidates, support)
    return cut_lineage(words.withColumnRenamed("word", "phrase").union(phrases)), langs.select("lang", "n")


# --- scores and report ----------------------------------------------------------------------

def _join(words, begin, length):
    return F.array_join(F.slice(words, begin, length), " ")


def collocations(docs: DataFrame, support: int = 30, top: int = 2000, lang: str = "lang", text: str = "text",
                 size: int = CHUNK_BYTES) -> DataFrame:
    """The ``top`` collocations of every language: ``lang, rank, phrase, a, l, r, n, score, k``.

    A phrase of 2 to 4 words with ``a >= support`` occurrences is scored at its weakest cut ``k``,
    ``floor(2000000 a / (l + r))`` (ties to the smallest ``k``).  It is dropped when a longer frequent phrase
    around it has at least 80 % of its occurrences.  Products are decimals of 38 digits."""
    found, langs = frequent_phrases(docs, support, lang, text, size)
    words = F.split("phrase", " ")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    candidates = found.withColumn("words", words).where(F.size("words") > 1).withColumnRenamed("f", "a")

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _join("words", F.lit(1), F.col("k")).alias("left"),
                       _join("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    inside = (candidates.where(F.size("words") > 2)
              .select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("length"))
              .select("lang", "a", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
              .groupBy("lang", _join("words", F.col("at"), F.col("length")).alias("phrase")).agg(F.max("a").alias("around")))
    kept = (scored.join(inside, ["lang", "phrase"], "left")
            .where(F.col("around").isNull() | (100 * exact("around") < 80 * exact("a"))).drop("around")
            .select("lang", "phrase", "a", "cut.*"))

    # the best of slices of a language first, so that no task sorts all phrases of one
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                                             "score", "k")
