"""The prefix trie against brute force, and contraction on trees of many shapes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ferrule.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, `a.b` int"


def said(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def brute(rows, heads=6, family=100):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, said(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        convs[c] = own.get(c - c % family, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in children[path])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def report(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    turns, ids = T.rebuilt(T.turns(df))
    out = T.trie_report(T.prefix_trie(turns, ids))
    return sorted(tuple(r) for r in out.drop("key").collect())


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in r.sample(range(400), n):
        for turn in range(r.choice([1, 2, 3, 8, 20])):
            rows.append((conv, turn, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "ä€", "", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = conversations(seed, 120)
    assert report(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, turnless conversations, equal conversations."""
    rows = [(None, 1, "user", "x"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, "user", "tie"), (5, 1, "user", "tie"),
            *[(c, 0, "user", "hot") for c in range(100, 200)], *[(c, 1, "assistant", "same") for c in range(100, 200)],
            (301, 0, "user", "only"), (302, 0, "user", "only"), (303, 0, "user", "x" * 100_000)]
    assert report(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert report(spark, []) == []


def test_conversation_over_many_tasks(spark):
    """One conversation holds nearly all rows: its prefix keys are continued over the ranges."""
    rows = [(7, t, "user", f"turn {t % 50}") for t in range(5000)] + [(8, t, "user", f"turn {t % 50}") for t in range(4990)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(5)
    out = T.numbered(T.turns(df)).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["place"]) for r in out] == [(c, t) for c, t, _, _ in rows]
    first, second = out[:5000], out[5000:]
    assert [bytes(r["key"]) for r in first[:4990]] == [bytes(r["key"]) for r in second]
    assert [bytes(r["key"]) for r in first[:-1]] == [bytes(r["parent"]) for r in first[1:]]
    assert len({bytes(r["key"]) for r in first}) == 5000


def tree(shape, n, r):
    if shape == "chain":
        return {k: k - 1 if k else None for k in range(n)}
    if shape == "star":
        return {k: 0 if k else None for k in range(n)}
    if shape == "broom":
        return {k: None if not k else k - 1 if k < n // 2 else n // 2 - 1 for k in range(n)}
    if shape == "caterpillar":
        return {k: None if not k else k - 1 if k % 2 == 0 and k == 2 else k - 2 if k % 2 == 0 else k - 1 for k in range(n)}
    return {k: r.randrange(max(0, k - 5), k) if k else None for k in range(n)}


@pytest.mark.parametrize("shape", ["chain", "star", "broom", "caterpillar", "random"])
def test_subtree_totals(spark, shape):
    r = random.Random(3)
    parent = tree(shape, 150, r)
    value = {k: r.randrange(-5, 50) for k in parent}
    total = dict(value)
    for k in sorted(parent, reverse=True):
        if parent[k] is not None:
            total[parent[k]] += total[k]
    df = spark.createDataFrame([(k, parent[k], value[k], 1) for k in parent], "key bigint, parent bigint, v bigint, one bigint")
    out = {x["key"]: (x["v"], x["one"]) for x in T.subtree_totals(df, ["v", "one"]).collect()}
    assert {k: v for k, (v, _) in out.items()} == total
    assert out[0][1] == 150


def test_ends_in_segments(spark, monkeypatch):
    """The ids of a hot node come in several segments from several ranges."""
    monkeypatch.setattr(T, "SEGMENT_BYTES", 64)
    ends = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("key"),
                                    F.col("id").alias("conv_id"))
    got = {bytes(r["key"]): r["ends_sha256"] for r in T.ends_digest(ends).collect()}
    want = {k: hashlib.sha256(",".join(str(i) for i in range(3000) if (i % 3 == 0) == (k == b"a")).encode()).hexdigest() for k in (b"a", b"b")}
    assert got == want
