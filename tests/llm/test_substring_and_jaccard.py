import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ferrule.llm import jaccard_join, repeats
from ferrule.llm.components import components
from ferrule.llm.words import words_of
from tests.llm import brute


def random_docs(seed, n, vocabulary, size):
    r = random.Random(seed)
    base = [[r.choice(vocabulary) for _ in range(r.randint(0, size))] for _ in range(n // 3)]
    out = []
    for k in range(n):
        w = list(r.choice(base)) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(0, size))]
        for _ in range(r.randint(0, 2)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((k * 7 % 1000, r.choice([" ", "\n", "  "]).join(w)))
    return out


@pytest.mark.parametrize("group_size", [5, 10_000])
def test_repeats_equal_brute_force(docs_of, group_size):
    rows = random_docs(1, 120, ["w%d" % i for i in range(40)], 40)
    got = repeats.remove_repeats(docs_of(rows), window=3, group_size=group_size, bucket_words=200).collect()
    want = {d: (n, gone, kept) for d, n, gone, kept in brute.without_repeats(rows, 3)}
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    for r in got:
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed
        assert all(s.end - s.begin >= 3 for s in r.spans)


def test_buckets_follow_bytes_and_rows(docs_of):
    blobs = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "ab%05d" % k * 40) for k in range(600)]
    copies = [(None, "equal text of a null id")] * 400 + [(None, None)] * 200
    for rows in (blobs, blobs + copies):
        source = docs_of(rows).select("doc_id", "text", F.col("doc_id").alias("row"))
        counts, deal = repeats.plan(source, 13, 12_000)
        assert counts.sum() == 0
        held = {}
        for r in repeats.packed_by_bucket(source, deal.keys).collect():
            table = repeats.unpack_batch(r.payload)
            held[r.bucket] = held.get(r.bucket, 0) + sum(len(t or "") + repeats.ROW_BYTES for t in table.column("text").to_pylist())
        assert sum(held.values()) == sum(len(t or "") + repeats.ROW_BYTES for _, t in rows)
        assert max(held.values()) < 4 * 12_000


def test_repeats_of_split_ids_equal_brute_force(docs_of):
    rows = random_docs(5, 150, "abcdef", 60)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else d, t) for k, (d, t) in enumerate(rows)]
    rows += [(None, rows[0][1])] * 100 + [(7, rows[4][1])] * 100
    got = repeats.remove_repeats(docs_of(rows), window=3, group_size=500, bucket_words=300).collect()
    assert sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == sorted(
        brute.without_repeats(rows, 3), key=str)


def test_repeats_odd_rows(docs_of, odd_rows):
    got = repeats.remove_repeats(docs_of(odd_rows)).collect()
    key = lambda x: (str(x[0]), x[1], x[2], x[3])
    assert sorted([(r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=key) == sorted(
        brute.without_repeats(odd_rows, 13), key=key)
    assert got[0].row["a.b"] == 3 and got[0].row.bucket == 1
    assert repeats.remove_repeats(docs_of([])).collect() == []


def test_plan_groups_sizes():
    counts = np.array([3, 0, 100, 4, 4, 4])
    first, bits, n = repeats.plan_groups(counts, 10)
    assert bits.tolist() == [0, 0, 4, 0, 0, 0]  # 100 suffixes in 16 parts
    assert first[0] == first[1] == 0 and first[2] == 1 and first[3] == first[4] == 17 and first[5] == 18 and n == 19


def sets(rows):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in rows]


@pytest.mark.parametrize("frequent", [2, 3, 64])
def test_jaccard_equals_brute_force(docs_of, frequent):
    rows = random_docs(2, 150, ["w%d" % i for i in range(300)], 160)
    got = jaccard_join.jaccard_components(docs_of(rows), frequent=frequent, group_sigs=500).collect()
    want = brute.jaccard_components(rows)
    assert {d: (n, c) for d, n, c in sets(got)} == want
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_jaccard_odd_rows(docs_of, odd_rows):
    got = sets(jaccard_join.jaccard_components(docs_of(odd_rows)).collect())
    by_id = {d: (n, c) for d, n, c in got if d is not None}
    assert len(got) == len(odd_rows)
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[4] == (11, -3) and by_id[5] == (11, -3) and by_id[-3] == (12, -3)
    assert by_id[6] == (1, 6) and by_id[9] == (1, 9)
    assert sorted((d, n, c) for d, n, c in got if d is None and n) == [(None, 11, -3)]
    assert jaccard_join.jaccard_components(docs_of([])).collect() == []
    kept = jaccard_join.one_per_group(docs_of(odd_rows))
    assert kept.columns == docs_of(odd_rows).columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [-3, 1, 2, 3, 6, 7, 8, 9, 10]


def test_linked_sets_share_a_signature():
    """Any two sets at the threshold share a signature under any frequent class."""
    r = np.random.default_rng(3)
    for _ in range(400):
        frequent = np.resize(r.random(4099) < r.choice([0.05, 0.5, 0.95]), 1 << jaccard_join.CELL_BITS)
        union = r.integers(0, 1 << 63, int(r.integers(4, 120)), dtype=np.uint64) << np.uint64(1)
        drop = len(union) // 4
        which = r.permutation(len(union))[:drop]
        cut = int(r.integers(0, drop + 1))
        one, two = np.sort(np.delete(union, which[:cut])), np.sort(np.delete(union, which[cut:]))
        if not jaccard_join.linked(len(union) - drop, len(one), len(two), 75):
            continue
        plain = [jaccard_join.prefix_signatures(s, 75, None)[0] for s in (one, two)]
        assert len(np.intersect1d(*plain))
        (a, met_a), (b, met_b) = (jaccard_join.prefix_signatures(s, 75, frequent) for s in (one, two))
        if met_a and met_b and len(np.setdiff1d(one, two)) + len(np.setdiff1d(two, one)):
            assert len(np.intersect1d(a, b))


def test_digest_depends_on_the_set_only():
    a, b, c = jaccard_join.shingle_sets(pa.array(["a b c d e a b c d e a", "A  b\nc d e a b c d e", "a b c d e a b c d f"]), 5)
    assert np.array_equal(a, b) is (len(a) == len(b))
    assert (jaccard_join.set_digest(a) == jaccard_join.set_digest(b)) is np.array_equal(a, b)
    assert jaccard_join.set_digest(a) != jaccard_join.set_digest(c)


def test_components_chain_and_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (-5, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 61))
    assert {got[i] for i in (200, 201, 202)} == {200} and got[300] == got[-5] == -5
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_words_whose_power_sums_collide_are_told_apart(docs_of):
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    found = words_of(pa.array([one, other, one + other, other + one, "x" * 70_000 + one, "x" * 70_000 + other]))
    assert len(set(found.hash.tolist())) == 6
    same = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{one} {same}"), (2, f"{other} {same}"), (3, f"{one} {same}")]
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs_of(rows), percent=90).collect()}
    assert [got[d].component_id for d in (1, 2, 3)] == [1, 2, 1]
    removed = {r.row.doc_id: r.n_removed for r in repeats.remove_repeats(docs_of(rows)).collect()}
    assert removed == {1: 0, 2: 0, 3: 13}


@pytest.mark.parametrize("size", [100, 400])
def test_pairs_to_verify_grow_with_the_cluster(docs_of, monkeypatch, size):
    r = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = [(d, " ".join(w if r.random() > 0.02 else f"u{r.randrange(10**6)}" for w in base)) for d in range(size)]
    counts = []
    verify = jaccard_join._verify

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verify", counted)
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs_of(rows)).collect()}
    assert sum(counts) <= 4 * size
    assert got == {d: c for d, (_, c) in brute.jaccard_components(rows).items()}
