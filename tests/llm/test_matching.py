import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ferrule.llm import decontaminate, queries, syncmers, url_rules
from tests.llm import brute
from tests.llm.conftest import SF_MID, SF_SMALL


def closed_syncmer_places(data: bytes):
    """Anchors by definition, with the kernel's own inner hash."""
    out = set()
    for i in range(len(data) - syncmers.K + 1):
        inner = [inner_hash(data[j:j + syncmers.S]) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.add(i)
    return out


def inner_hash(piece: bytes) -> int:
    x = np.frombuffer(piece, "<u8").copy()
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return int(((x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(32))[0])


def test_anchors_by_definition_and_context_free():
    r = random.Random(1)
    texts = [bytes(r.choice(b"abcd ") for _ in range(n)) for n in (0, 5, 19, 20, 21, 80, 300)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    text, place, h = syncmers.anchors(data, offsets)
    for k, t in enumerate(texts):
        assert set(place[text == k].tolist()) == closed_syncmer_places(t)
    inside = b"xyz" + texts[-1] + b"!!"
    _, moved, h2 = syncmers.anchors(np.frombuffer(inside, np.uint8), np.array([0, len(inside)]))
    own = dict(zip(place[text == 6].tolist(), h[text == 6].tolist(), strict=True))
    there = dict(zip((moved - 3).tolist(), h2.tolist(), strict=True))
    assert own and all(there[p] == x for p, x in own.items())


def test_likeness():
    r = random.Random(2)
    a = " ".join(str(r.randrange(10 ** 6)) for _ in range(400))
    b = " ".join(str(r.randrange(10 ** 6)) for _ in range(400))
    same, edit, other, empty, tiny = syncmers.sketches(pa.array([a, syncmers.edited(a, b), b, "", "x"]))
    assert syncmers.likeness(same, same) == 1 and syncmers.likeness(empty, empty) == 1
    assert syncmers.likeness(empty, tiny) == 0 and syncmers.likeness(tiny, tiny) == 1
    assert 0.3 < syncmers.likeness(same, edit) < 0.7 and syncmers.likeness(same, other) < 0.05
    assert syncmers.as_text(empty) == "" and len(syncmers.as_text(tiny)) == 14


def test_long_texts_keep_every_anchor():
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = text(4000)
    a, b = text(30_000) + passage + text(30_000), text(10_000) + passage + text(50_000)
    one, two = syncmers.sketches(pa.array([a, b]))
    places = sorted(closed_syncmer_places(a[:9000].encode()))
    assert one[1][:len(places)].tolist() == [p >> 4 for p in places] and len(one[0]) > 8000
    assert syncmers.as_text(one) == "".join("%08x%06x" % x for x in zip(one[0].tolist(), one[1].tolist(), strict=True))
    assert 0.02 < syncmers.likeness(one, two) < 0.05
    same, = syncmers.sketches(pa.array(["again and again " * 500]))
    assert len(same[0]) > 500 and syncmers.likeness(same, same) == 1


@pytest.mark.parametrize("cost", [0, 1 << 60])
def test_in_order_equals_the_table(monkeypatch, cost):
    monkeypatch.setattr(syncmers, "PAIR_COST", cost)
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.randrange(k) for _ in range(r.randrange(1, 40))] for k in [r.choice((2, 5, 30))] * 2)
        row = [0] * (len(b) + 1)
        for x in a:
            old = row
            row = [0]
            for k, y in enumerate(b):
                row.append(old[k] + 1 if x == y else max(row[-1], old[k + 1]))
        assert syncmers.in_order(np.array(a, np.uint64), np.array(b, np.uint64)) == row[-1]


def by_hand(rows):
    key = lambda r: (0 if r[0] is None else 1, -(r[0] or 0), r[1] or "")
    ordered = sorted(rows, key=key)
    out = []
    for k, (d, t) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edit = syncmers.edited(t, n)
        one, two, three = syncmers.sketches(pa.array([t, edit, n], pa.string()))
        out.append((d, len(t), edit, syncmers.as_text(one), syncmers.as_text(two), syncmers.likeness(one, two),
                    syncmers.likeness(one, three)))
    return out


@pytest.mark.parametrize("bucket", [300, 1 << 20])
def test_compare_with_next(docs_of, odd_rows, monkeypatch, bucket):
    monkeypatch.setattr(syncmers, "BUCKET_BYTES", bucket)
    for rows in (odd_rows, [(5, "only one text here, longer than a k-mer")]):
        got = syncmers.compare_with_next(docs_of(rows)).collect()
        have = [(r.row.doc_id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got]
        assert sorted(have, key=str) == sorted(by_hand(rows), key=str)
    assert syncmers.compare_with_next(docs_of([])).collect() == []
    plain = syncmers.fingerprints(docs_of(odd_rows)).collect()
    assert {(r.row.doc_id, r.fingerprint) for r in plain} == {(d, f) for d, _, _, f, _, _, _ in by_hand(odd_rows)}


def test_fingerprint_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF_SMALL).collect()]
    want = {d: (n, hashlib.sha256(e.encode()).hexdigest(), f, g) for d, n, e, f, g, _, _ in by_hand(rows)}
    got = queries.op7_fingerprints(spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got} == want
    assert np.mean([r.near_edited for r in got]) > 0.4 and np.mean([r.near_next for r in got]) < 0.1


def test_leaks_tolerate_substitutions(spark, docs_of):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (15, 20, 40, 59, 4)]
    filler = lambda n: [word() for _ in range(n)]

    def changed(w, every):
        return [word() if k % every == every - 1 else x for k, x in enumerate(w)]

    docs = [(1, filler(50) + items[0] + filler(30)), (2, filler(9) + changed(items[1], 6)), (3, changed(items[2], 5) + filler(100)),
            (4, filler(30) + items[3][20:40] + filler(5)), (5, filler(60)), (6, filler(20) + items[2][5:11] + filler(20)),
            (7, filler(5) + items[3][:8] + ["x"] + items[3][8:20]), (8, [w.upper() + "," for w in items[0]]), (9, items[4] * 3)]
    rows = [(d, " ".join(w)) for d, w in docs] + [(None, " ".join(items[0])), (10, None), (1, " ".join(docs[0][1]))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (None, "q w")],
                                  "item_id bigint, text string")
    for block in (1_000_000, 30):
        got = decontaminate.leaks(docs_of(rows), bench, block_tokens=block).collect()
        assert {(x.doc_id, x.item_id) for x in got} == {(1, 0), (2, 1), (3, 2), (4, 3), (7, 3), (8, 0), (None, 0)}
        assert len(got) == 7 and all(0 < x.overlap <= 1 for x in got)
    kept = decontaminate.without_leaks(docs_of(rows), bench)
    assert kept.columns == docs_of(rows).columns and sorted(x.doc_id for x in kept.collect()) == [5, 6, 9, 10]
    assert decontaminate.leaks(docs_of([]), bench).collect() == []
    assert decontaminate.leaks(docs_of(rows), bench.limit(0)).collect() == []


def leaks_by_hand(rows, items):
    """{(doc_id, item_id): matched} over all diagonals: segments whose every prefix and suffix scores above 0."""
    out = {}
    for d, text in rows:
        for i, item in items:
            matched = set()
            for diagonal in range(-len(item), len(text)):
                ok = [0 <= k + diagonal < len(text) and x == text[k + diagonal] for k, x in enumerate(item)]
                for a in range(len(ok)):
                    score = best = 0
                    for b in range(a, len(ok)):
                        score += 1 if ok[b] else -2
                        if score <= 0:
                            break
                        if score > best:  # no shorter one scores as much, so every suffix is above 0
                            best = score
                            if sum(ok[a:b + 1]) >= decontaminate.MIN_RUN:
                                matched |= {k for k in range(a, b + 1) if ok[k]}
            if matched and len(matched) >= min(13, -(-3 * len(item) // 5)):
                out[d, i] = len(matched)
    return out


def test_clustered_substitutions_equal_brute_force(spark, docs_of):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(n, [word() for _ in range(n)]) for n in (21, 26, 40)]
    swap = lambda w, *parts: [word() if any(a <= k < b for a, b in parts) else x for k, x in enumerate(w)]
    docs = [(1, swap(items[0][1], (9, 13))), (2, swap(items[1][1], (12, 17))),
            (3, swap(items[2][1], (3, 4), (7, 13), (16, 17), (20, 26), (29, 30), (33, 40)))]
    for d in range(4, 60):
        w = list(items[d % 3][1])
        for _ in range(r.randrange(1, 5)):
            a = r.randrange(len(w))
            w = swap(w, (a, a + r.randrange(1, 7)))
            if r.random() < 0.2:
                del w[r.randrange(len(w))]
        docs.append((d, [word() for _ in range(r.randrange(9))] + w))
    want = leaks_by_hand(docs, items)
    assert {(1, 21), (2, 26), (3, 40)} <= set(want) and len(want) < len(docs)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    got = decontaminate.leaks(docs_of([(d, " ".join(w)) for d, w in docs]), bench).collect()
    assert {(x.doc_id, x.item_id): x.matched for x in got} == want


def test_every_planted_passage_is_found(spark):
    docs = queries.documents(spark, SF_MID).collect()
    items = spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, SF_MID).collect()}
    whole = {(d.doc_id, i.item_id) for d in docs for i in items
             if b" " + b" ".join(brute.lower(i.text)) + b" " in b" " + b" ".join(brute.lower(d.text)) + b" "}
    assert len(whole) > 10 and whole <= got
    for d, i in got - whole:
        a, b = (set(brute.lower(x)) for x in (next(x.text for x in docs if x.doc_id == d), next(x.text for x in items if x.item_id == i)))
        assert len(a & b) >= 8


def page_rows():
    return [(1, "https://www.example.com/en/1?x=1"), (2, "http://m.example.com/en/2#top"), (3, "https://EXAMPLE.com/de/3"),
            (4, "https://a.example.net/es/4"), (5, "https://example.net/fr"), (6, "https://example.net/fr/"), (7, None), (8, "no scheme"),
            (9, "https://com"), (10, "https://com/"), (11, "https://example.org/ads/x"), (12, "https://notexample.org/?a=1&sessionid=3"),
            (13, ""), (None, "https://x.example.com/en/"), (2, "http://m.example.com/en/2#top"), (14, "://"), (15, "https://foo.org/a.com/"),
            (16, "https://Ünder.com/" + "p" * 5000), (17, "ftp://net/es/x://com/")]


def test_url_rules_inline_and_joined(spark):
    pages = spark.createDataFrame([(p, u, "h", "x") for p, u in page_rows()], "page_id bigint, url string, html string, target string")
    out = [sorted((str(r.row.page_id), r.host, r.path, str(r.rule), r.verdict)
                  for r in url_rules.judge(pages, url_rules.default_rules(), inline_rules=n).collect()) for n in (1000, 0)]
    assert out[0] == out[1] and len(out[0]) == len(page_rows())
    by = {r[0]: r[1:] for r in out[0]}
    assert by["1"] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by["2"] == ("m.example.com", "/en/2", "example.com/en/", "block")
    assert by["3"] == ("example.com", "/de/3", "com/", "allow")
    assert by["4"][2:] == ("net/es/", "block") and by["5"][2:] == ("None", "allow") and by["6"][2:] == ("net/fr/", "block")
    assert by["7"] == by["8"] == by["13"] == ("", "", "None", "allow")
    assert by["9"] == ("com", "", "None", "allow") and by["10"][2] == "com/"
    assert by["11"][2:] == ("None", "block") and by["12"][2:] == ("None", "block") and by["15"][2:] == ("None", "allow")
    assert by["16"][0] == "Ünder.com" and by["17"][2:] == ("net/es/", "block")
    assert url_rules.judge(pages.limit(0), url_rules.default_rules()).collect() == []


def test_host_rules_do_not_reach_into_query_or_fragment(spark):
    rows = [(1, "https://foo.net?next=example.com/en/x"), (2, "http://foo.org#a.net/es/"), (3, "http://shop.fr?u=b.example.com/en/1"),
            (4, "http://a.net/es/?u=example.com/en/1")]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    for inline in (1000, 0):
        got = {r.row.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, url_rules.default_rules(), inline_rules=inline).collect()}
        assert got == {1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("net/es/", "block")}


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = [url_rules.host_rule("www.rare.com", "/", "block"), url_rules.pattern_rule("*.*", "block"),
             url_rules.pattern_rule("/shop/*item", "allow"), url_rules.host_rule("com", "/sh", "allow")]
    urls = spark.createDataFrame([("www.a.com/shop",)] * 3 + [("www.rare.com/x",)], "target string")
    assert url_rules.rarest_tokens(urls, rules) == {"www.rare.com/": "rare", "*.*": None, "/shop/*item": "shop", "com/sh": "com"}
    pages = spark.createDataFrame([(1, "http://rare.com/shopping"), (2, "http://a.org/shop/9item")], "page_id int, url string")
    got = {r.row.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert got == {1: ("com/sh", "allow"), 2: (None, "allow")}
