"""Archives: monolithic streams, their normal form, and reading by the index."""

import gzip
import hashlib
import json
import base64

import pytest

from ferrule.llm import warc

SCHEMA = "page_id bigint, url string, html string, archive string, `a.b` int, id string"


def expected(rows, revisit_from=0):
    """Brute force over (page_id, url, html) rows."""
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        group = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        first = min(group) if group and len(payload) >= revisit_from else None
        refers = first if first is not None and page != first else None
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [(1, "https://a.example/x", "<p>one</p>"), (2, "https://b.example/ y\r\nZ: 1", "<p>one</p>"), (3, None, None), (4, "u", ""),
        (5, "https://c.example", "ü€ \r\n\r\nWARC/1.1\r\n\r\n" * 3), (None, "https://d.example", "<p>one</p>"), (None, "v", "alone"),
        (6, "https://e.example", "z" * 3_000_000), (1, "https://a.example/x", "<p>one</p>"), (-7, "w", "<p>two</p>"), (8, "w", "<p>two</p>")]


def written(spark, rows, tmp_path, **options):
    pages = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(3)
    return warc.write_archives(pages, str(tmp_path / "streams"), **options)


@pytest.mark.parametrize("revisit_from", [0, 1, 11])
def test_round_trip(spark, tmp_path, revisit_from):
    manifest = warc.normalise(written(spark, ROWS, tmp_path, revisit_from=revisit_from, size=1000), str(tmp_path / "normal"))
    out = warc.read_archives(manifest).collect()
    got = sorted([(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out], key=str)
    assert got == expected(ROWS, revisit_from)
    payloads = {r["id"]: r["payload"] for r in out if r["record_type"] == "response"}
    assert bytes(payloads[6]) == b"z" * 3_000_000 and bytes(payloads[5]).decode() == ROWS[4][2]
    assert {r["url"] for r in out if r["id"] == 2} == {"https://b.example/%20y%0D%0AZ:%201"}
    assert {r["url"] for r in out if r["id"] == 3} == {None}


def test_members_and_index(spark, tmp_path):
    streams = written(spark, ROWS, tmp_path)
    whole = {r["archive"]: gzip.open(r["archive"]).read() for r in streams.collect()}
    manifest = warc.normalise(streams, str(tmp_path / "normal")).collect()
    # the normal form inflates to the same bytes, and every index entry to one record of its own
    assert sorted(gzip.open(r["archive"]).read() for r in manifest) == sorted(whole.values())
    for r in manifest:
        raw = open(r["archive"], "rb").read()
        entries = [json.loads(line) for line in open(r["index"])]
        assert len(entries) == r["records"] and sum(e["length"] for e in entries) == len(raw)
        for e in entries:
            one = gzip.decompress(raw[e["offset"]:e["offset"] + e["length"]])
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and e["id"].encode() in one
    # a normalised archive is a valid input again
    again = warc.normalise(spark.createDataFrame([(r["archive"], r["records"]) for r in manifest], "archive string, records bigint"),
                           str(tmp_path / "again")).collect()
    assert sorted(gzip.open(r["archive"]).read() for r in again) == sorted(whole.values())


def test_empty_table(spark, tmp_path):
    manifest = warc.normalise(written(spark, [], tmp_path), str(tmp_path / "normal"))
    assert warc.read_archives(manifest).count() == 0


def test_damaged_archives(tmp_path):
    good = warc.record(1, "u", b"payload", None, "2020-01-01T00:00:00Z") * 2
    for name, raw in [("cut-stream", gzip.compress(good)[:-12]), ("cut-record", gzip.compress(good[:-3])),
                      ("no-record", gzip.compress(b"hello\r\n\r\n"))]:
        path = tmp_path / name
        path.write_bytes(raw)
        with pytest.raises((ValueError, Exception)) as caught:
            warc.normalise_archive(str(path), str(tmp_path))
        assert name in str(caught.value)


def test_inflation_is_bounded():
    """A stream of high ratio comes out in steps, from one stream or several members."""
    import io

    raw = gzip.compress(b"a" * (50 << 20)) + gzip.compress(b"b" * 10)
    steps = [len(s) for s in warc.inflated(io.BytesIO(raw), "x")]
    assert max(steps) <= warc.STEP and sum(steps) == (50 << 20) + 10
