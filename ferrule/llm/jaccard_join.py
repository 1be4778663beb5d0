"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the distinct hashes of its word shingles.  Two sets with ``overlap >=
3/4 of the union`` (the default threshold) leave at most a quarter of either set unmatched, so
under one global order of the shingles their prefixes must share something.  With the order "rare
before frequent, then by hash":

* **rare class, single tokens**: of the first ``floor(n/4) + 1`` shingles of a set one at least is in the other;
* **frequent class, combinations of k = 2**: a frequent shingle alone links too many sets, so pairs of
  *consecutive* frequent shingles of the prefix are indexed, and the prefix is extended.  A shingle
  that only one set holds breaks two consecutive pairs at most; with ``r`` rare shingles all unmatched, a prefix of
  ``floor(n/2) - 2r + 2`` frequent ones keeps one pair whole.  (a unmatched here and b there give ``2a + b <=
  floor(n/2)`` broken pairs.)  The prefix that ends first in the order decides, so both sets index the common signature.

The frequent class is found by the first pass itself: all shingles count as rare, and a shingle among the
first ``COUNTED`` times the prefix of more than ``frequent`` sets sets its cell in a bitmap of ``2**CELL_BITS`` bits (so its size is
bounded; a rare shingle in a marked cell is merely treated as frequent).  Groups up to that size give their few
pairs at once; sets whose prefix met a frequent shingle are indexed again with both classes.

Equal sets are one class, known by the set's 64-bit digest, and never compared.  Candidates are verified
on the texts, exactly on the shingle hashes.  In a group of more than ``frequent`` sets each is first compared with one
pivot only, the member with the largest share of frequent shingles (a star, not all pairs).  Then the sets of such groups
that are still in different components are joined once more, on prefixes of only those shingles that others of them hold,
ordered by their exact counts; sets whose own shingles use up the allowance drop out.  No link between components is lost, and no large group emits all its pairs.

Cases: null or empty texts have an empty set and link with nothing; texts shorter than a shingle are one shingle;
a null doc_id takes part, but names no component unless all ids of the component are null; rows with the same doc_id
are judged each by its own text (so an id may show more than one component); an empty table gives an empty result;
other columns are ignored, and kept untouched by ``one_per_group``; long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.components import components
from ferrule.llm.exchange import from_gaps, gaps, runs
from ferrule.llm.rows import whole_row, with_fields
from ferrule.llm.words import cut, freeing, mix, sequence_hash, slices, window_hashes, words_of
from ferrule.session import cut_lineage

CELL_BITS = 24
COUNTED = 2  # prefixes' worth of shingles that the first pass counts: what takes the place of frequent ones
_NONE = np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a slice."""
    words = words_of(column, lower=True)
    h, at = window_hashes(words, width)
    first = np.searchsorted(at, words.first)
    out = []
    for k in range(len(words.first) - 1):
        n = int(words.first[k + 1] - words.first[k])
        if n >= width:
            s = np.sort(h[first[k]:first[k + 1]])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            out.append(np.array([sequence_hash(words.hash[words.first[k]:words.first[k + 1]])], np.uint64))
        else:
            out.append(_NONE)
    return out


def set_digest(s: np.ndarray) -> int:
    """64-bit digest of a sorted set, as a signed integer."""
    if not len(s):
        return 0
    total = np.array([np.bitwise_xor.reduce(mix(s)) ^ np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return int(mix(total + np.uint64(len(s))).view(np.int64)[0])


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def prefix_signatures(s: np.ndarray, percent: int, frequent: np.ndarray | None) -> tuple[np.ndarray, bool]:
    """Signatures of a sorted set, and whether its single-token prefix meets a frequent shingle."""
    n = len(s)
    need = n - (-(-percent * n // 100)) + 1  # unmatched shingles allowed, plus one
    singles = s[:need]
    if frequent is None:
        return singles, False
    marked = frequent[s >> np.uint64(64 - CELL_BITS)]
    if not marked[:need].any():
        return singles, False
    rare, often = s[~marked], s[marked]
    if len(rare) >= need:
        return rare[:need], True
    unmatched = 2 * (need - 1) + 1 - 2 * len(rare)
    often = often[:max(0, unmatched) + 2]
    pairs = mix(often[:-1] * np.uint64(0x9FB21C651E98DF25) ^ mix(often[1:]))
    return np.concatenate((rare, pairs)), True


def _index(source: DataFrame, width: int, percent: int, groups: int, cells: bytes | None,
           wanted: bytes | None = None) -> DataFrame:
    """Packed signatures by group: rows (grp, digests, sizes, slots, wide, sigs, counted), the last the high halves of the
    shingles that are only counted.  With ``wanted`` (bits of digests) all shingles of those sets.  With ``cells`` (bits of the
    frequent class) only sets whose prefix met a frequent shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, chosen = (None if x is None else np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in (cells, wanted))
        for part in slices(batches, size=8 << 20):
            found: dict[int, tuple] = {}  # equal sets of a slice are indexed once
            for piece in cut(part):
                for s in shingle_sets(piece.column("text"), width):
                    if not len(s) or (digest := set_digest(s)) in found:
                        continue
                    if chosen is not None:
                        if chosen[(digest & (1 << 64) - 1) >> 64 - CELL_BITS]:
                            found[digest] = (len(s), s, _NONE, 0)
                    else:
                        sig, met = prefix_signatures(s, percent, frequent)
                        if met or frequent is None:
                            more = s[len(sig):COUNTED * len(sig)].copy() if frequent is None else _NONE
                            often = 0 if frequent is None else int(frequent[s >> np.uint64(64 - CELL_BITS)].sum())
                            found[digest] = (len(s), sig.copy(), more, often)
            if not found:
                continue
            digests = np.array(list(found), np.int64).tobytes()
            sizes = np.array([(n, often) for n, _, _, often in found.values()], np.int32).tobytes()
            slot = np.repeat(np.arange(len(found)), [len(sig) for _, sig, _, _ in found.values()])
            sig = np.concatenate([sig for _, sig, _, _ in found.values()])
            more = (np.concatenate([m for _, _, m, _ in found.values()]) >> np.uint64(32)).astype(np.uint32)
            more_group = (mix(more) % np.uint64(groups)).astype(np.int32)
            order = np.argsort(more_group, kind="stable")
            counted = {g: more[order[a:b]].tobytes() for g, a, b in runs(more_group[order])}
            group = (mix(sig) % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group.astype(np.uint16) if groups < 1 << 16 else group, kind="stable")
            group, slot, sig = group[order], slot[order], sig[order]
            out = []
            for g, a, b in runs(group):
                packed, wide = gaps(slot[a:b])
                out.append((g, digests, sizes, packed, wide, sig[a:b].tobytes(), counted.pop(g, b"")))
            out += [(g, b"", b"", b"", 1, b"", rest) for g, rest in counted.items()]
            for k in range(0, len(out), 32):
                columns = list(zip(*out[k:k + 32], strict=True))
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int8(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                 ["grp", "digests", "sizes", "slots", "wide", "sigs", "counted"])

    return source.select("text").mapInArrow(
        run, "grp int, digests binary, sizes binary, slots binary, wide tinyint, sigs binary, counted binary")


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The signature groups of two different sets or more: (signatures, first member of each and the end,
    members ordered by group and digest, their sizes, their counts of frequent shingles)."""
    digest, size, sig = [], [], []
    for batch in table.to_batches():
        for row in batch.to_pylist():
            slot = from_gaps(row["slots"], row["wide"])
            digest.append(np.frombuffer(row["digests"], np.int64)[slot])
            size.append(np.frombuffer(row["sizes"], np.int32).reshape(-1, 2)[slot])
            sig.append(np.frombuffer(row["sigs"], np.uint64))
    sig = np.concatenate(sig)
    ordered = np.sort(sig)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        none = np.zeros(0, np.int64)
        return twice, np.zeros(1, np.int64), none, none, none
    node = np.minimum(np.searchsorted(twice, sig), len(twice) - 1)
    several = np.flatnonzero(twice[node] == sig)
    node = node[several]
    digest, size = np.concatenate(digest)[several], np.concatenate(size)[several].astype(np.int64)
    order = np.lexsort((digest, node))
    node, digest, size = node[order], digest[order], size[order]
    keep = np.append(True, (node[1:] != node[:-1]) | (digest[1:] != digest[:-1]))
    node, digest, size = node[keep], digest[keep], size[keep]
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    count = np.diff(np.append(begin, len(node)))
    pick = np.repeat(count > 1, count)
    begin = np.cumsum(count[count > 1]) - count[count > 1]
    return (twice[node[np.cumsum(count) - 1]][count > 1], np.append(begin, pick.sum()), digest[pick], size[pick, 0],
            size[pick, 1])


_CANDIDATES = "kind tinyint, a bigint, b bigint, n bigint, lo bigint, lo_n bigint"
_PAIR, _CELL, _MEMBER = 0, 1, 2


def _candidates(index: DataFrame, frequent: int, percent: int, first_pass: bool) -> DataFrame:
    """From the packed signatures: the pairs of groups of at most ``frequent`` members; and of the larger groups, in the
    first pass their cells of the frequent class, in the second their members.

    Groups of equal members are taken once in a task, and known by a hash of the members."""

    def group(table: pa.Table) -> pa.Table:
        sig, first, digest, size, often = _groups(table)
        count = np.diff(first)
        out = [np.zeros((6, 0), np.int64)]
        named = np.add.reduceat(mix(digest.view(np.uint64)), first[:-1]) if len(count) else np.zeros(0, np.uint64)
        if first_pass:
            halves = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counted").to_pylist()])
            halves, times = np.unique(halves, return_counts=True)
            cells = np.unique(np.concatenate((sig[count > frequent] >> np.uint64(64 - CELL_BITS),
                                              halves[times > frequent] >> np.uint32(32 - CELL_BITS)))).astype(np.int64)
            out.append(np.stack([np.full(len(cells), _CELL), cells, *[np.zeros(len(cells), np.int64)] * 4]))
        _, once = np.unique(named, return_index=True)
        for k in np.unique(count[once][count[once] <= frequent]).tolist():
            rows = first[:-1][once[count[once] == k]]
            i, j = np.triu_indices(k, 1)
            a, b = (rows[:, None] + i).ravel(), (rows[:, None] + j).ravel()
            fits = np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent
            pairs = np.unique(np.stack((digest[a[fits]], digest[b[fits]])), axis=1)
            out.append(np.concatenate((np.full((1, pairs.shape[1]), _PAIR), pairs, np.zeros((3, pairs.shape[1]), np.int64))))
        if not first_pass:
            for g in once[count[once] > frequent].tolist():
                x, y = first[g], first[g + 1]
                n, pivot = int(y - x), x + np.argmax(often[x:y] / size[x:y])
                out.append(np.stack((np.full(n, _MEMBER), np.full(n, named[g].view(np.int64)), digest[x:y], size[x:y],
                                     np.full(n, digest[pivot]), np.full(n, size[pivot]))))
        found = np.concatenate(out, axis=1)
        return pa.table([pa.array(found[0].astype(np.int8)), *[pa.array(found[k]) for k in range(1, 6)]],
                        ["kind", "a", "b", "n", "lo", "lo_n"])

    return index.groupBy("grp").applyInArrow(freeing(group), _CANDIDATES)


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, checked on their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_id, kept_set = None, _NONE
        for part in slices(batches, "text_b"):
            a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
            sets_b = shingle_sets(part.column("text_b"), width)
            new = np.append(a[0] != kept_id, a[1:] != a[:-1])
            fresh = iter(shingle_sets(part.column("text_a").filter(pa.array(new)), width))
            good = np.zeros(len(a), dtype=bool)
            for k in range(len(a)):
                if new[k]:
                    kept_id, kept_set = a[k], next(fresh)
                common = len(np.intersect1d(kept_set, sets_b[k], assume_unique=True))
                good[k] = linked(common, len(kept_set), len(sets_b[k]), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    of_b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b").sortWithinPartitions(
        "a").mapInArrow(run, "a bigint, b bigint")


def _fits(a: str, b: str, percent: int) -> Column:
    """Size filter: the smaller set has at least ``percent`` of the larger."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _overlap_fits(common: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of ``a`` and ``b`` shingles with at most ``common`` shared ones can link."""
    return common * (100 + percent) >= (a + b) * percent


def _held_shingles(texts_in: DataFrame, ids: DataFrame, total_shingles: int, width: int, percent: int, group_sigs: int,
                   each: bool) -> DataFrame:
    """The shingles that two or more of the sets ``ids(id)`` hold: their number per set ``(id, held)``, or with ``each``
    one row ``(id, shingle, holders)`` for each.  Sets that share a bitmap cell with a wanted one hold shingles too, so
    the numbers are upper bounds."""
    groups = int(max(1, -(-total_shingles // group_sigs)))

    def count(table: pa.Table) -> pa.Table:
        sig, first, digest, _, _ = _groups(table)
        if each:
            times = np.diff(first)
            return pa.table({"id": digest, "shingle": np.repeat(sig, times).view(np.int64), "holders": np.repeat(times, times)})
        digest, n = np.unique(digest, return_counts=True)
        return pa.table({"id": digest, "held": n.astype(np.int64)})

    index = _index(texts_in, width, percent, groups, None, bitmap(ids, "id")).groupBy("grp")
    if each:
        return index.applyInArrow(freeing(count), "id bigint, shingle bigint, holders bigint").join(ids, "id", "left_semi")
    counts = index.applyInArrow(freeing(count), "id bigint, held bigint").groupBy("id").agg(F.sum("held").alias("held"))
    return counts.join(ids, "id", "left_semi")


def _remaining_links(texts_in: DataFrame, texts: DataFrame, left: DataFrame, tested: DataFrame, total_shingles: int,
                     width: int, percent: int, group_sigs: int) -> list[DataFrame]:
    """Links between sets in different components, from ``left(id, n, component, smallest)`` and the pairs
    ``tested(a, b)`` before (``a < b``).

    A prefix join over the shared shingles alone, rarest first by their exact number of holders: a set's shingles that
    no other set holds use up its allowance for unmatched ones, so few others have to be indexed.  Of a linking pair the
    first common shingle has, in either set, at most ``held - overlap`` shared shingles before it.

    Rounds come first: per shingle one pivot (the set with the largest share of shared shingles), and each set is compared
    with the one pivot of another component that it meets most often.  Linked components merge, and shingles held
    inside one component fall out.  When a round links few of its pairs, the holders that are still in different components
    are compared with each other."""
    held = _held_shingles(texts_in, left.select("id"), total_shingles, width, percent, group_sigs, True)
    own = Window.partitionBy("id")
    overlap = lambda a, b: F.ceil((a + b) * percent / (100 + percent))
    rows = (held.withColumn("rank", F.row_number().over(own.orderBy("holders", "shingle")) - 1)
            .withColumn("held", F.count(F.lit(1)).over(own)).join(left, "id")
            .where(F.col("rank") <= F.col("held") - overlap(F.col("n"), F.col("smallest"))))
    rows = cut_lineage(rows.select("shingle", "id", "n", "component", (F.col("held") - F.col("rank")).alias("room"),
                                   (F.col("held") / F.col("n")).alias("share")))
    pair = (F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))
    found = []
    while True:
        between = rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        rows = cut_lineage(rows.join(between.select("shingle"), "shingle", "left_semi"))
        pivot = rows.groupBy("shingle").agg(F.max(F.struct("share", "id", "n", "component")).alias("top"))
        met = (rows.join(pivot, "shingle").withColumns({"id_b": F.col("top.id"), "n_b": F.col("top.n")})
               .where((F.col("component") != F.col("top.component")) & _fits("n", "n_b", percent))
               .groupBy("id", *pair).agg(F.count(F.lit(1)).alias("times"), F.max("top.share").alias("share"))
               .join(tested, ["a", "b"], "left_anti"))
        best = met.groupBy("id").agg(F.max(F.struct("times", "share", "a", "b")).alias("best"))
        pairs = cut_lineage(best.select("best.a", "best.b").distinct())
        tried = pairs.count()
        if not tried:
            break
        links = cut_lineage(_verify(pairs, texts, width, percent))
        found.append(links)
        tested = tested.unionByName(pairs)
        made = links.count()
        if made:
            place = rows.select("id", "component").distinct()
            merged = components(links.join(place.toDF("a", "x"), "a").join(place.toDF("b", "y"), "b")
                                .select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("component", "merged")
            rows = cut_lineage(rows.join(merged, "component", "left")
                               .withColumn("component", F.coalesce("merged", "component")).drop("merged"))
        if made * 8 < tried:
            break
    between = rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    rows = rows.join(between.select("shingle"), "shingle", "left_semi")
    other = rows.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "component", "room")])
    pairs = (rows.join(other, "shingle").where(
        (F.col("component") != F.col("component_b")) & (F.col("id") < F.col("id_b")) & _fits("n", "n_b", percent)
        & (F.least("room", "room_b") >= overlap(F.col("n"), F.col("n_b")))).select(*pair).distinct())
    pairs = cut_lineage(pairs.join(tested, ["a", "b"], "left_anti"))
    return [*found, cut_lineage(_verify(pairs, texts, width, percent))]


def bitmap(df: DataFrame, column: str) -> bytes:
    """Bits of the cells (top bits) of a bigint column; at most ``2**CELL_BITS`` rows are collected."""
    cells = df.select(F.shiftrightunsigned(column, 64 - CELL_BITS).alias("cell")).distinct().toArrow().column("cell")
    bits = np.zeros(1 << CELL_BITS, dtype=bool)
    bits[cells.to_numpy()] = True
    return np.packbits(bits).tobytes()


def _texts_of(texts_in: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """One text of every wanted set ``ids(id)``: the scan lets only texts through whose digest may be wanted."""
    wanted = texts_in.sparkSession.sparkContext.broadcast(bitmap(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        for part in slices(batches):
            digest = np.array([set_digest(s) for s in shingle_sets(part.column("text"), width)], np.int64)
            _, once = np.unique(digest, return_index=True)
            once = once[bits[digest[once].view(np.uint64) >> np.uint64(64 - CELL_BITS)]]
            yield pa.RecordBatch.from_arrays([pa.array(digest[once]), part.column("text").take(pa.array(once))], ["id", "text"])

    return (texts_in.select("text").mapInArrow(run, "id bigint, text string").join(ids, "id", "left_semi")
            .groupBy("id").agg(F.min("text").alias("text")))


def jaccard_links(texts_in: DataFrame, total_shingles: int, width: int, percent: int, frequent: int,
                  group_sigs: int) -> DataFrame:
    """Links ``(a, b)`` between digests of different sets that keep every component whole, from
    ``texts_in(text)``."""
    groups = int(max(1, -(-total_shingles * (100 - percent) // 100 // group_sigs)))
    first = cut_lineage(_candidates(_index(texts_in, width, percent, groups, None), frequent, percent, True))
    pairs = first.where(F.col("kind") == _PAIR).select("a", "b")
    cells = first.where(F.col("kind") == _CELL).select(F.shiftleft("a", 64 - CELL_BITS).alias("sig"))
    second = cut_lineage(_candidates(_index(texts_in, width, percent, groups, bitmap(cells, "sig")), frequent, percent, False))
    members = second.where(F.col("kind") == _MEMBER).select(F.col("a").alias("key"), F.col("b").alias("id"), "n", "lo", "lo_n")
    star = members.where((F.col("lo") != F.col("id")) & _fits("lo_n", "n", percent)).select(
        F.least("lo", "id").alias("a"), F.greatest("lo", "id").alias("b"))
    pairs = cut_lineage(pairs.unionByName(second.where(F.col("kind") == _PAIR).select("a", "b")).unionByName(star).distinct())
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(members.select("id")).distinct())
    texts = cut_lineage(_texts_of(texts_in, ids, width))
    links = cut_lineage(_verify(pairs, texts, width, percent))

    # what is still in different components; a set shares at most its shingles that other members hold too
    held = _held_shingles(texts_in, cut_lineage(members.select("id").distinct()), total_shingles, width, percent, group_sigs, False)
    placed = cut_lineage(members.select("key", "id", "n").distinct().join(held, "id").join(components(links), "id", "left")
                         .select("key", "id", "n", "held", F.coalesce("component", "id").alias("component")))
    least = placed.groupBy("key").agg(F.min("n").alias("least"))
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    able = placed.join(least, "key").withColumn("smallest", smallest).where(
        _overlap_fits(F.col("held"), F.col("n"), F.col("smallest"), percent))
    open_keys = able.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    left = cut_lineage(able.join(open_keys.select("key"), "key", "left_semi").groupBy("id").agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.min("smallest").alias("smallest")))
    for more in _remaining_links(texts_in, texts, left, pairs, total_shingles, width, percent, group_sigs):
        links = links.unionByName(more)
    return links


def _classes(docs: DataFrame, width: int, percent: int, doc_id: str, text: str, frequent: int,
             group_sigs: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, digest)`` of every row, and ``(digest, least, component)`` of every set that is not empty."""
    if percent < 50:
        raise ValueError("the extended prefixes hold for thresholds of a half or more")
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), width)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([set_digest(s) for s in sets], pa.int64())], ["doc_id", "n", "digest"])

    rows = cut_lineage(source.mapInArrow(describe, "doc_id bigint, n bigint, digest bigint"))
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    labels = components(jaccard_links(source.select("text"), total, width, percent, frequent, group_sigs))
    classes = (rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
               .join(labels.withColumnRenamed("id", "digest"), "digest", "left")
               .select("digest", "least", F.coalesce("component", "digest").alias("component")))
    return rows, cut_lineage(classes)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text",
                       frequent: int = 8, group_sigs: int = 1_000_000) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id of its component)
    and ``digest`` (of its set).  ``percent`` is at least 50."""
    rows, classes = _classes(docs, width, percent, doc_id, text, frequent, group_sigs)
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "component").select("digest", "component_id")
    return (rows.where("n > 0").join(named, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "digest")
            .unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"),
                                                    F.col("doc_id").alias("component_id"), "digest")))


def one_per_group(docs: DataFrame, width: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text",
                  frequent: int = 8, group_sigs: int = 1_000_000) -> DataFrame:
    """Exactly one row of each group: of smallest id (null last), then of smallest set digest, then of smallest text.
    A row without shingles is a group of its own."""
    rows, classes = _classes(docs, width, percent, doc_id, text, frequent, group_sigs)
    held = (rows.where("n > 0").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times"))
            .join(classes.select("digest", "component"), "digest"))
    best = held.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                                                        F.col("digest").alias("set"))).alias("best"))
    chosen = (F.col("digest") == F.col("best.set")) & F.col("doc_id").eqNullSafe(F.col("best.id"))
    marked = cut_lineage(held.join(best, "component").select(
        F.col("digest").alias("set"), F.col("doc_id").alias("id"), "times", chosen.alias("chosen")))
    tagged = docs.select(whole_row(docs).alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"),
                         F.col(text).cast("string").alias("text"))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            digest = [set_digest(s) for s in shingle_sets(part.column("text"), width)]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(digest, pa.int64())],
                                             ["row", "doc_id", "digest"])

    tagged = tagged.mapInArrow(tag, with_fields([tagged.schema["row"]], "doc_id bigint, digest bigint"))
    same = (F.col("digest") == F.col("set")) & F.col("doc_id").eqNullSafe(F.col("id"))
    kept = tagged.join(marked.where("NOT chosen OR times > 1"), same, "left_anti").select("row.*")
    again = marked.where("chosen AND times > 1")  # several rows of the chosen id and set: one of them
    if not again.limit(1).count():
        return kept
    one = tagged.join(again, same, "left_semi").groupBy("digest").agg(F.min_by("row", F.col("row").getField(text)).alias("row"))
    return kept.union(one.select("row.*"))
