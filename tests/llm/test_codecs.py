import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import bpe, queries, simple8b
from tests.llm import brute
from tests.llm.conftest import SF_SMALL

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
TOKENIZERS = simple8b.LibraryEncoder(P.path("byte_bpe_50k.json"))


def ids_of(encoder, texts):
    ids, first = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab re'slt \n\r\t.,-0é×÷ß", max_size=60)), min_size=1, max_size=8))
def test_encoders_equal_the_libraries(texts):
    want = [LIBRARY.encode_ordinary(t) for t in texts]
    assert ids_of(CODEC, texts) == want
    assert ids_of(TOKENIZERS, texts) == want
    ids, first = CODEC.encode(pa.array(texts, pa.string()))
    data, begin = CODEC.decode(ids)
    assert data.tobytes() == "".join(texts).encode()


def test_long_matches_use_one_tree():
    r = random.Random(1)
    for text in ("a" * 3000, " " * 2000, "ab" * 900, "".join(r.choice("abcde") for _ in range(2000)), "日本" * 500):
        assert ids_of(CODEC, [text]) == [LIBRARY.encode_ordinary(text)]


def thue_morse(a, b):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(1024))


def test_matches_whose_power_sums_collide():
    texts = [thue_morse("a", "b"), thue_morse("b", "a"), "x " + thue_morse("b", "a") + " " + thue_morse("a", "b")]
    want = [LIBRARY.encode_ordinary(t) for t in texts]
    assert want[0] != want[1]
    for encoder in (CODEC, TOKENIZERS):
        assert ids_of(encoder, texts) == want
        assert [ids_of(encoder, [t])[0] for t in texts] == want


def test_cache_trusts_bytes_not_hashes(monkeypatch):
    monkeypatch.setattr(bpe, "piece_hashes", lambda data, start: np.diff(np.append(start, len(data))).astype(np.uint64) % np.uint64(3))
    weak = bpe.PieceCache(P.PATTERN, lambda some: bpe.merge_many(some, CODEC.ranks))
    for texts in (["one two"], ["six ten", "", "one two three"], ["日本 語 x", "two two"]):
        assert ids_of(weak, texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_added_tokens_as_the_library_takes_them():
    texts = ["a <|endoftext|> b", None, "", "plain text", "<|endoftext|><|endoftext|>", "<|endof text|> é"]
    library = TOKENIZERS.whole
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(want[0]) == 4
    assert ids_of(TOKENIZERS, texts) == want


def test_cache_turnover_changes_nothing():
    small = bpe.PieceCache(P.PATTERN, lambda some: bpe.merge_many(some, CODEC.ranks), entries=3)
    texts = [f"the {k} words of {k * k} and the rest" for k in range(40)]
    for at in range(0, 40, 4):
        assert ids_of(small, texts[at:at + 4]) == [LIBRARY.encode_ordinary(t) for t in texts[at:at + 4]]


def test_round_trip_odd_rows(docs_of, odd_rows):
    rows = odd_rows + [(11, "<|endoftext|> x")]
    got = bpe.bpe_round_trip(docs_of(rows), P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.decoded) == (r.row.text or "").encode()
        assert np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode_ordinary(r.row.text or "")
        assert r.row["a.b"] == 3
    assert bpe.bpe_round_trip(docs_of([]), P.path("byte_bpe_50k.tiktoken")).collect() == []


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1) | st.integers(0, 1) | st.integers(0, 50_000) | st.just(0), max_size=400),
       st.integers(1, 9))
def test_simple8b_round_trip(values, times):
    values = np.array(values * times, dtype=np.uint64)
    words, block_words, escapes = simple8b.pack(values)
    assert block_words.sum() == len(words)
    assert np.array_equal(simple8b.unpack(words, block_words, escapes, len(values)), values)


def test_simple8b_packs_tightly():
    assert len(simple8b.pack(np.zeros(1024, np.uint64))[0]) == 5
    assert len(simple8b.pack(np.ones(600, np.uint64))[0]) == 10
    assert len(simple8b.pack(np.full(1024, 40_000, np.uint64))[0]) == 342


def test_id_files(spark, docs_of, odd_rows, scratch):
    odd_rows = [*odd_rows, (12, "a <|endoftext|> b")]
    simple8b.write_ids(docs_of(odd_rows), scratch + "/ids", P.path("byte_bpe_50k.json"))
    got = simple8b.read_ids(spark, scratch + "/ids").collect()
    got = sorted(got, key=lambda r: r.start)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [d for d, _ in order]
    start = 0
    for r, (_, text) in zip(got, order, strict=True):
        want = TOKENIZERS.whole.encode(text or "", add_special_tokens=False).ids + [0]
        raw = np.array(want, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(want), zlib.crc32(raw), raw)
        start += len(want)
    simple8b.write_ids(docs_of([]), scratch + "/none", P.path("byte_bpe_50k.json"))
    assert simple8b.read_ids(spark, scratch + "/none").collect() == []


def test_queries_over_all_documents(spark):
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, SF_SMALL).collect()}
    got = {r.doc_id: r for r in queries.op4_byte_bpe(spark, SF_SMALL).collect()}
    packed = {r.doc_id: r for r in queries.op3_token_ids(spark, SF_SMALL).collect()}
    assert set(got) == set(packed) == set(texts)
    start = 0
    for d in sorted(texts):
        ids = LIBRARY.encode_ordinary(texts[d])
        raw = np.array(ids, "<u4").tobytes()
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (
            len(ids), brute.sha256(raw), brute.sha256(texts[d].encode()))
        assert (packed[d].start, packed[d].n_tokens, packed[d].ids_crc32) == (start, len(ids) + 1, zlib.crc32(raw + bytes(4)))
        start += len(ids) + 1
