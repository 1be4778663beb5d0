"""The prefix trie of conversations, its subtree totals found by parallel tree contraction.

Nodes.  Turns are sorted by (conversation, turn) over ranges of rows, so a conversation may span many
tasks.  The key of a prefix is eight polynomials modulo ``2**31 - 1`` over the SHA-256 of its turns (248 bits);
a task continues the keys of a conversation that begins in a task before with one carry per task.
Equal prefixes have equal keys, and a node is an aggregate over its key.

Totals.  Contraction alternates *rake* (all leaves give their sums to their parents and go) and *compress*
(every chain of nodes with one child left is resolved by pointer doubling and spliced out) until
the root alone is left.  After a rake and a compress at most half of the leaves are left, so the rounds grow with
the logarithm of the nodes, whatever the depth.  A raked node's sum is its total; a node
that was spliced out keeps the end of its chain and what lies between, and gets its total when the rounds are
re-expanded in reverse.  All joins have a unique key on both sides; hot parents only meet in aggregates.

Cases: a null role or text counts as empty; rows without a conv_id belong to no conversation; turns that tie
(also repeated rows) follow the digest of role and text, a null turn comes first; an empty table has no
node, not even a root; other columns are ignored, whatever their names; a conversation without turns is a member
of the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut_lineage

PRIME = (1 << 31) - 1
# One base per lane (any residues of large order).
BASES = np.array([1103515245, 1664525, 214013, 22695477, 1140671485, 134775813, 69069, 742938285], dtype=np.uint64)
LANES = len(BASES)
ROOT_KEY = b"\0" * (4 * LANES)
SEGMENT_BYTES = 1 << 20


# --- turns in order ---------------------------------------------------------------------

def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """``(conv_id, turn, said, chars)``: the SHA-256 of role and text, and the text's code points."""
    said_by = F.coalesce(F.col(role).cast("string"), F.lit(""))
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(said_by).cast("string"), F.lit(":"), said_by, words), 256)).alias("said"),
        F.char_length(words).cast("bigint").alias("chars"))


def _lanes(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), "<u4")
    return raw.reshape(-1, LANES).astype(np.uint64)


def _keys(lanes: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(lanes.astype("<u4")).tobytes()
    width = 4 * LANES
    return pa.Array.from_buffers(pa.binary(), len(lanes), [
        None, pa.py_buffer((np.arange(len(lanes) + 1) * width).astype(np.int32)), pa.py_buffer(raw)])


def _powers(n: int) -> np.ndarray:
    """``BASES**k`` modulo the prime for k < n."""
    out = np.ones((max(n, 1), LANES), dtype=np.uint64)
    filled = 1
    while filled < n:
        step = np.array([pow(int(b), filled, PRIME) for b in BASES], dtype=np.uint64)
        more = min(filled, n - filled)
        out[filled:filled + more] = out[:more] * step % PRIME
        filled += more
    return out


def _power(n: int) -> np.ndarray:
    return np.array([pow(int(b), n, PRIME) for b in BASES], dtype=np.uint64)


def numbered(source: DataFrame) -> DataFrame:
    """``turns`` with their ``place`` (from 0), the ``key`` of the prefix that ends there and that of its ``parent``.

    One range shuffle; what crosses a task's border is one carry per task, collected."""
    ranged = (source.select("conv_id", "turn", "said", "chars", F.monotonically_increasing_id().alias("row"))
              .repartitionByRange("conv_id", "turn", "said", "row")
              .sortWithinPartitions("conv_id", "turn", "said", "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, count, state = TaskContext.get().partitionId(), None, 0, np.zeros(LANES, dtype=np.uint64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("conv_id").to_numpy()
            opens = np.append(True, ids[1:] != ids[:-1])
            start = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
            going_on = int(np.searchsorted(np.cumsum(opens), 2)) if ids[0] == conv else 0  # rows of the last batch's conversation
            place = np.arange(n) - start
            power = _powers(n)[place]
            if going_on:
                place[:going_on] += count
                power[:going_on] = power[:going_on] * _power(count) % PRIME
            term = _lanes(batch.column("said")) % PRIME * power % PRIME
            total = np.cumsum(term, axis=0)
            before = total - term
            base = np.zeros((n, LANES), dtype=np.uint64)
            base[:] = before[start]
            parent, key = before - base, total - base
            parent[:going_on] += state
            key[:going_on] += state
            parent, key = parent % PRIME, key % PRIME
            conv, count, state = ids[-1], int(place[-1]) + 1, key[-1].copy()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, part, dtype=np.int32)), batch.column("conv_id"), pa.array(place), batch.column("said"),
                batch.column("chars"), _keys(parent), _keys(key)],
                ["part", "conv_id", "place", "said", "chars", "parent", "key"])

    schema = "part int, conv_id bigint, place bigint, said binary, chars bigint, parent binary, key binary"
    local = cut_lineage(ranged.mapInArrow(run, schema))
    runs = local.groupBy("conv_id", "part").agg(F.max("place").alias("last"), F.max_by("key", "place").alias("key"))
    spread = runs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    carry, at, count, state = {}, None, 0, None
    # every task holds the end of one such conversation and the begin of another: two rows per task at most
    for row in runs.join(spread, "conv_id").orderBy("conv_id", "part").collect():
        if row["conv_id"] != at:
            at, count, state = row["conv_id"], 0, np.zeros(LANES, dtype=np.uint64)
        else:
            carry[at, row["part"]] = (count, state)
        state = (state + _power(count) * np.frombuffer(row["key"], "<u4").astype(np.uint64)) % PRIME
        count += row["last"] + 1
    out = local.select("conv_id", "place", "said", "chars", "parent", "key")
    if not carry:
        return out

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, parts = batch.column("conv_id").to_numpy(), batch.column("part").to_numpy()
            place = batch.column("place").to_numpy().copy()
            parent, key = _lanes(batch.column("parent")), _lanes(batch.column("key"))
            change = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])))
            for a, b in zip(change, np.append(change[1:], len(ids)), strict=True):
                if (int(ids[a]), int(parts[a])) in carry:
                    n, state = carry[int(ids[a]), int(parts[a])]
                    place[a:b] += n
                    for lanes in (parent, key):
                        lanes[a:b] = (lanes[a:b] * _power(n) + state) % PRIME
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(place), batch.column("said"),
                                              batch.column("chars"), _keys(parent), _keys(key)],
                                             ["conv_id", "place", "said", "chars", "parent", "key"])

    return local.mapInArrow(shift, "conv_id bigint, place bigint, said binary, chars bigint, parent binary, key binary")


def rebuilt(source: DataFrame, heads: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: ``c`` takes its first ``h = crc32(decimal c) % heads`` turns from
    conversation ``c - c % family`` (all it has, none if it is absent) and goes on with its own turns after its first
    ``h``.  Returns their turns and all conv_ids, also those left without a turn."""
    own = cut_lineage(numbered(source).select("conv_id", "place", "said", "chars"))
    ids = own.groupBy("conv_id").agg((F.max("place") + 1).alias("length"))
    convs = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
                       (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    of_base = ids.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    plan = cut_lineage(convs.join(of_base, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("taken")))
    opening = own.where(F.col("place") < heads - 1).withColumnRenamed("conv_id", "base")
    first = (plan.where("taken > 0").join(opening, "base").where("place < taken")
             .select("conv_id", F.col("place").alias("turn"), "said", "chars"))
    rest = (own.join(plan, "conv_id").where("place >= h")
            .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("turn"), "said", "chars"))
    return first.union(rest), plan.select("conv_id")


# --- the trie -------------------------------------------------------------------------------

@dataclass
class Trie:
    """``nodes``: ``key, parent, depth, chars, conv_id`` (smallest member), ``n_convs``; ``ends``: ``key, conv_id`` of the
    node where each conversation ends; ``places``: ``conv_id, place, said, key`` (which turn of which conversation a node is)."""

    nodes: DataFrame
    ends: DataFrame
    places: DataFrame


def prefix_trie(source: DataFrame, conv_ids: DataFrame) -> Trie:
    """The trie of ``turns`` rows; ``conv_ids`` lists all conversations, also those without turns."""
    places = cut_lineage(numbered(source))
    below = places.groupBy("key", (F.col("place") + 1).alias("depth")).agg(
        F.first("parent").alias("parent"), F.first("chars").alias("chars"),
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = conv_ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    columns = ["key", "parent", "depth", "chars", "conv_id", "n_convs"]
    zero = F.lit(0).cast("bigint")
    nodes = below.select(*columns).union(root.select(
        F.lit(ROOT_KEY).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"),
        zero.alias("chars"), "conv_id", "n_convs"))
    last = places.groupBy("conv_id").agg(F.max_by("key", "place").alias("key"))
    ends = conv_ids.join(last, "conv_id", "left").select(F.coalesce("key", F.lit(ROOT_KEY)).alias("key"), "conv_id")
    return Trie(cut_lineage(nodes), ends, places)


def ends_digest(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: SHA-256 of the ascending decimal conv_ids of a node, joined by commas.

    The ids of a node are joined over ranges of rows first; one task then hashes its segments as a stream."""
    ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, key, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def segment():
            return pa.RecordBatch.from_arrays([
                pa.array([key], pa.binary()), pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                pa.array([",".join(held)], pa.string())], ["key", "part", "seq", "ids"])

        for batch in batches:
            for own, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (own != key or size > SEGMENT_BYTES):
                    yield segment()
                    seq, held, size = seq + 1, [], 0
                key = own
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield segment()

    segments = ranged.mapInArrow(join, "key binary, part int, seq int, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()),
                                              pa.array([d for _, d in done], pa.string())], ["key", "ends_sha256"])
            done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())],
                                             ["key", "ends_sha256"])

    return (segments.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "ids")
            .mapInArrow(digest, "key binary, ends_sha256 string"))


# --- contraction ----------------------------------------------------------------------------

def subtree_totals(tree: DataFrame, measures: list[str], node: str = "key", parent: str = "parent") -> DataFrame:
    """Sums of ``measures`` over the subtree of every node (its own row included).

    ``tree`` has one row per node; the root's parent is null.  Returns ``(node, *measures)``."""
    own = [F.col(m).cast("bigint").alias(f"a_{m}") for m in measures]
    over = [F.lit(0).cast("bigint").alias(f"e_{m}") for m in measures]
    # a_: what the node holds of its subtree; e_: what was spliced out between the node and its present parent
    active = tree.select(F.col(node).alias("id"), F.col(parent).alias("up"), *own, *over)
    totals, chains = [], []
    while True:
        kids = active.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
        marked = cut_lineage(active.join(kids, "id", "left"))
        # rake
        is_leaf = F.col("kids").isNull() & F.col("up").isNotNull()
        leaves = marked.where(is_leaf)
        totals.append(leaves.select("id", *[F.col(f"a_{m}").alias(m) for m in measures]))
        given = leaves.groupBy(F.col("up").alias("id")).agg(
            *[F.sum(F.col(f"a_{m}") + F.col(f"e_{m}")).alias(f"g_{m}") for m in measures])
        rest = cut_lineage(marked.where(~is_leaf).join(given, "id", "left").select(
            "id", "up", *[(F.col(f"a_{m}") + F.coalesce(f"g_{m}", F.lit(0))).alias(f"a_{m}") for m in measures],
            *[f"e_{m}" for m in measures]))
        # compress: chains of nodes with one child left
        live = rest.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(
            F.count(F.lit(1)).alias("live"), F.min(F.struct("id", *[f"e_{m}" for m in measures])).alias("child"))
        unary = rest.where(F.col("up").isNotNull()).join(live.where("live = 1"), "id")
        first = cut_lineage(unary.select(
            "id", "up", F.col("child.id").alias("to"), *[f"e_{m}" for m in measures],
            *[(F.col(f"a_{m}") + F.col(f"child.e_{m}")).alias(f"o_{m}") for m in measures]))
        if rest.where(F.col("up").isNotNull()).isEmpty():
            totals.append(rest.select("id", *[F.col(f"a_{m}").alias(m) for m in measures]))
            break
        if first.isEmpty():
            active = rest
            continue
        chain = first
        while True:
            on = chain.select(F.col("id").alias("to"), F.col("to").alias("n_to"),
                              *[F.col(f"o_{m}").alias(f"n_{m}") for m in measures])
            moved = cut_lineage(chain.join(on, "to", "left").select(
                "id", "up", F.coalesce("n_to", "to").alias("to"), *[f"e_{m}" for m in measures],
                *[(F.col(f"o_{m}") + F.coalesce(f"n_{m}", F.lit(0))).alias(f"o_{m}") for m in measures],
                F.col("n_to").isNotNull().alias("moved")))
            chain = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        chains.append(chain.select("id", "to", *[F.col(f"o_{m}").alias(m) for m in measures]))
        top = chain.join(first.select(F.col("to").alias("id")), "id", "left_anti").select(
            F.col("to").alias("id"), F.col("up").alias("n_up"),
            *[(F.col(f"o_{m}") + F.col(f"e_{m}")).alias(f"n_{m}") for m in measures])
        active = rest.join(chain.select("id"), "id", "left_anti").join(top, "id", "left").select(
            "id", F.coalesce("n_up", "up").alias("up"), *[f"a_{m}" for m in measures],
            *[F.coalesce(f"n_{m}", f"e_{m}").alias(f"e_{m}") for m in measures])
    # re-expand, last round first
    known = totals[0]
    for more in totals[1:]:
        known = known.union(more)
    for chain in reversed(chains):
        end = known.select(F.col("id").alias("to"), *[F.col(m).alias(f"t_{m}") for m in measures])
        known = known.union(cut_lineage(chain.join(end, "to").select(
            "id", *[(F.col(m) + F.col(f"t_{m}")).alias(m) for m in measures])))
    return known.withColumnRenamed("id", node)


def trie_report(trie: Trie) -> DataFrame:
    """Per node: ``key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    children = trie.nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(trie.nodes.join(children, "key", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")))
    totals = subtree_totals(nodes.select(
        "key", "parent", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    top = nodes.where("depth = 0").select(F.lit(1).cast("bigint").alias("depth"), F.col("conv_id").alias("root_conv_id"))
    over = nodes.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("over_conv_id"))
    return (nodes.join(F.broadcast(top), "depth", "left")  # one row
            .join(over, "parent", "left").join(totals, "key").join(ends_digest(trie.ends), "key", "left")
            .select("key", "conv_id", "depth", F.coalesce("root_conv_id", "over_conv_id").alias("parent_conv_id"), "n_convs",
                    "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
