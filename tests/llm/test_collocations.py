"""Collocations against brute force, in one shard and in many."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ferrule.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int, `a.b` int"


def brute(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[at:at + size])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in cand.items():
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in cand.items()):
                continue
            rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, docs, words):
    r = random.Random(seed)
    vocabulary = ["The", "the", "of", "été", "x-1", "New", "york", "city", "hall", "of course", "a b c d", "日本"]
    return [(r.choice(["en", "de", None]),
             "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randrange(words))))
            for _ in range(docs)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(k, t, g, "clash", 1, 2) for k, (g, t) in enumerate(rows)], SCHEMA).repartition(3)
    out = C.collocations(df, **options)
    return sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("size", [200, 20_000, C.CHUNK_BYTES])
@pytest.mark.parametrize("support, top", [(5, 10_000), (30, 7)])
def test_against_brute_force(spark, size, support, top):
    rows = corpus(1, 60, 120)
    assert run(spark, rows, support=support, top=top, size=size) == brute(rows, support, top)


def test_long_texts_are_cut_behind_separators(spark):
    rows = [("en", "one two three, four five " * 400), ("en", "no separator here " * 300), ("en", None), ("en", ""), (None, " ,\t. "),
            ("en", "one two three, four five " * 400)]
    assert run(spark, rows, size=64) == brute(rows, 30, 2000)


def test_local_support_is_proportional(spark):
    """A language in one shard is mined at the whole support, one in several shards at less; bounds stay tight."""
    cut = spark.createDataFrame([("one", 3, 100), *[("many", k % 5, 5) for k in range(20)]], "lang string, shard int, n_words bigint")
    supported, langs = C.with_support(cut, 30)
    assert {(r["lang"], r["what"] >> 36, r["what"] & 255) for r in supported.collect()} == {("one", 30, 3), *[("many", 6, k) for k in range(5)]}
    assert {(r["lang"], r["n"], r["need"]) for r in langs.collect()} == {("one", 100, 1), ("many", 100, 5)}
    assert {(r["what"] >> 8) & ((1 << 28) - 1) for r in supported.where("lang = 'many'").collect()} == {5}


def test_hash_of_words_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "alpha été 日本", "de", "", 0, 0)], SCHEMA)
    chunk = C.Chunk({k: v for k, v in C.chunks(df).first().asDict().items()})
    words = [w.decode() for w in chunk.words.to_pylist()]
    table = spark.createDataFrame([("de", w) for w in words], "lang string, word string")
    got = {r["word"]: r["h"] % (1 << 64) for r in table.select("word", F.xxhash64("lang", "word").alias("h")).collect()}
    assert got == dict(zip(words, chunk.hashes().tolist(), strict=True))


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == []
