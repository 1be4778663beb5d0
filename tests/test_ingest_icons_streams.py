"""Sheet ingest, icon audit and streaming on literal fixtures."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ferrule.operators import icons as V
from ferrule.operators.ingest import melt, sheet_rows
from ferrule.plans.ingest import ingest_sheet
from ferrule.sources.sheet import SheetError, read_sheet


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)
    return path


SHEET = """Timestamp,Flow,Temp,flow,Empty,New Tag
,Main flow,Tank temp,Second flow,,
,m3/h,C,,,
2024-01-01 00:00:00,1.5,20,9,,0
2024-01-01 01:00:00,,21,7,,x
not a time,3,3,3,,3
2024-01-01 02:00:00,NaN,-1,,,
"""


def test_sheet_metadata_and_melt(spark, scratch):
    path = _write(os.path.join(scratch, "s.csv"), SHEET)
    sheet = read_sheet(spark, path)
    assert sheet.time_column == "timestamp"
    assert list(sheet.tag_columns) == ["flow", "temp", "empty", "new tag"]
    # of equal names the last column describes the tag
    assert sheet.descriptions["flow"] == "Second flow" and sheet.units["temp"] == "C"
    assert sheet.descriptions["empty"] is None
    rows = sheet_rows(sheet)
    long = {(r.timestamp.hour, r.tag_name): r.value for r in melt(rows, list(sheet.tag_columns)).collect()}
    # duplicate header: first non-missing cell wins; NaN is missing; zero kept; bad timestamp dropped
    assert long == {(0, "flow"): "1.5", (0, "temp"): "20", (0, "new tag"): "0",
                    (1, "flow"): "7", (1, "temp"): "21", (1, "new tag"): "x", (2, "temp"): "-1"}


def test_sheet_errors(spark, scratch):
    with pytest.raises(SheetError):
        read_sheet(spark, _write(os.path.join(scratch, "a.csv"), "a,b\nx,y\nu,v\n1,2\n"))
    bad = read_sheet(spark, _write(os.path.join(scratch, "b.csv"), "time,a\n,\n,\njunk,1\nworse,2\n"))
    with pytest.raises(SheetError):
        sheet_rows(bad)


def test_ingest_flow(spark, scratch):
    path = _write(os.path.join(scratch, "s.csv"), SHEET)
    tags = spark.createDataFrame([(1, "flow", "kept", None, 1, True, 1)],
                                 "id int, name string, description string, unit_of_measure string, "
                                 "plant_id int, is_active boolean, data_source_id int")
    stored = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0), "100", "minute", "GOOD")],
                                   "tag_id int, timestamp timestamp_ntz, value string, frequency string, "
                                   "quality string")
    r = ingest_sheet(spark, path, tags, stored)
    assert r.frequency == "hour"
    assert [(c.tag_name, c.existing_frequency) for c in r.conflicts.collect()] == [("flow", "minute")]
    m = {x.name: (x.id, x.is_new) for x in r.mapping.collect()}
    assert m == {"flow": (1, False), "empty": (2, True), "new tag": (3, True), "temp": (4, True)}
    desc = {x.name: x.description for x in r.tags.collect()}
    assert desc["flow"] == "kept" and desc["temp"] == "Tank temp"
    assert desc["empty"] == "Sensor data collected at hour intervals"
    ins = {(x.tag_id, x.timestamp.hour) for x in r.inserted.collect()}
    assert (1, 0) not in ins and (1, 1) in ins  # stored row wins
    c = r.counters.first()
    assert (c.row_count, c.total_values, c.nan_values, c.zero_values, c.expected_records) == (3, 12, 5, 1, 12)


SVG_OK = '<svg xmlns="http://www.w3.org/2000/svg"><rect width="1"/></svg>'
SVG_ONCLICK = '<svg><rect onclick="x()" width="1"/></svg>'
SVG_SCRIPT = '<svg><script>alert(1)</script></svg>'
NOT_XML = '<svg><rect></svg>'
NO_SVG = '<root><rect/></root>'


def test_svg_audit_and_clean(spark):
    files = [("ok.svg", SVG_OK), ("click.svg", SVG_ONCLICK), ("script.svg", SVG_SCRIPT), ("bad.svg", NOT_XML),
             ("nosvg.svg", NO_SVG), ("pic.png", SVG_OK), ("big.svg", "<svg>" + " " * (1024 * 1024) + "</svg>")]
    df = spark.createDataFrame([(n, bytearray(c.encode())) for n, c in files], "file_name string, content binary")
    out = {r.file_name: r for r in V.clean_svg(V.audit_svg(df)).collect()}
    assert out["ok.svg"].is_valid and out["click.svg"].is_valid
    assert out["script.svg"].error == "SVG contains potentially dangerous element: script"
    assert out["bad.svg"].error.startswith("Invalid XML/SVG format: mismatched tag")
    assert out["nosvg.svg"].error == "File does not contain valid SVG content"
    assert out["pic.png"].error == "File must be an SVG file (.svg)"
    assert out["big.svg"].error == "SVG file too large (max 1MB)"
    cleaned = out["click.svg"].clean_svg
    assert cleaned.startswith('<?xml version="1.0" encoding="UTF-8"?>') and "onclick" not in cleaned
    assert 'xmlns="http://www.w3.org/2000/svg"' in cleaned


def test_svg_clean_namespaced_script(spark):
    ns = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:x="urn:x"><x:script>bad()</x:script><rect/></svg>'
    df = spark.createDataFrame([("ns.svg", bytearray(ns.encode()))], "file_name string, content binary")
    audited = V.audit_svg(df).withColumn("is_valid", F.lit(True))
    cleaned = V.clean_svg(audited).first().clean_svg
    assert "bad()" not in cleaned


def test_keep_first_stream_across_batches(spark, scratch):
    from ferrule.streaming import run_keep_first_ingest

    src = os.path.join(scratch, "src")
    ts = dt.datetime(2024, 1, 1)
    schema = "tag_id int, timestamp timestamp_ntz, value string, src_row long"
    spark.createDataFrame([(1, ts, "a", 1), (2, ts, "b", 2)], schema).coalesce(1).write.parquet(src + "/p1")
    spark.createDataFrame([(1, ts, "late", 3), (3, ts, "c", 4), (3, ts, "c2", 5)], schema) \
        .coalesce(1).write.parquet(src + "/p2")
    out = run_keep_first_ingest(spark, src + "/*/*.parquet", schema, lambda d: d,
                                target=os.path.join(scratch, "tgt"), checkpoint=os.path.join(scratch, "ck"),
                                max_files_per_trigger=1)
    got = sorted((r.tag_id, r.value) for r in out.collect())
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_daily_rollup_stream_closed_windows(spark, scratch):
    from ferrule.streaming import run_daily_rollup

    src = os.path.join(scratch, "src")
    schema = "tag_id int, timestamp timestamp_ntz, value string"
    rows = [(1, dt.datetime(2024, 1, 1, 5), "2"), (1, dt.datetime(2024, 1, 1, 6), "4"),
            (1, dt.datetime(2024, 1, 2, 12), "1")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    out = run_daily_rollup(spark, src, schema, lambda d: d, sink=os.path.join(scratch, "out"),
                           checkpoint=os.path.join(scratch, "ck")).collect()
    assert [(r.bucket, r.avg_value, r.sample_count) for r in out] == [(dt.datetime(2024, 1, 1), 3.0, 2)]


def test_bounded_dedup_stream(spark, scratch):
    from ferrule.streaming import bounded_dedup_stream

    src = os.path.join(scratch, "src")
    schema = "tag_id int, timestamp timestamp_ntz, value string"
    ts = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, ts, "a"), (1, ts, "b"), (2, ts, "c")], schema).coalesce(1).write.parquet(src)
    q = (bounded_dedup_stream(spark.readStream.schema(schema).parquet(src)).writeStream
         .format("memory").queryName("ferrule_dedup").option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.tag_id for r in spark.sql("SELECT * FROM ferrule_dedup").collect()) == [1, 2]


def test_batch_writer_replay_is_idempotent(spark, scratch):
    from ferrule.streaming import keep_first_batch_writer

    target = os.path.join(scratch, "tgt")
    write = keep_first_batch_writer(target)
    schema = "tag_id int, timestamp timestamp_ntz, value string, src_row long"
    ts = dt.datetime(2024, 1, 1)
    b0 = spark.createDataFrame([(1, ts, "a", 1)], schema)
    b1 = spark.createDataFrame([(1, ts, "dup", 2), (2, ts, "b", 3)], schema)
    write(b0, 0)
    write(b1, 1)
    write(b1, 1)  # replay after a failure
    got = sorted((r.tag_id, r.value) for r in spark.read.parquet(target).collect())
    assert got == [(1, "a"), (2, "b")]


def _brute_force_audit(name, data: bytes):
    import xml.etree.ElementTree as ET

    if not name.lower().endswith(".svg"):
        return "File must be an SVG file (.svg)"
    if len(data) > 1024 * 1024:
        return "SVG file too large (max 1MB)"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "File encoding not supported (use UTF-8)"
    try:
        ET.fromstring(text)
    except ET.ParseError as e:
        return f"Invalid XML/SVG format: {e}"
    low = text.lower()
    if "<svg" not in low:
        return "File does not contain valid SVG content"
    for el in ("script", "object", "embed", "iframe", "link"):
        if f"<{el}" in low:
            return f"SVG contains potentially dangerous element: {el}"
    return None


def test_icon_audit_query_matches_brute_force(spark):
    import pandas as pd

    from ferrule.plans.queries import q_icon_audit

    sf = "/root/testdata/sf0.001"
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    want = {f"page_{r.page_id}.svg": _brute_force_audit(f"page_{r.page_id}.svg", r.html.encode("utf-8"))
            for r in pages.itertuples()}
    got = {r.file_name: r.error for r in q_icon_audit(spark, sf).collect()}
    assert got == want and len(got) == len(pages)


def test_wide_sheet_dates_and_conflicts(spark, scratch):
    """5,000 tags; one day/month order per file; a held upload inserts nothing; an empty one is an error."""
    from ferrule.plans.ingest import ingest_sheet
    from ferrule.sources.sheet import SheetError

    n = 5000
    tags = [f"tag{i}" for i in range(n)]
    path = os.path.join(scratch, "wide.csv")
    lines = [["Time"] + tags, [""] * (n + 1), [""] * (n + 1)]
    lines += [[f"5/{d}/2024"] + ["0" if d == 1 else "1.5"] * (n - 1) + [""] for d in (1, 2, 13)]
    with open(path, "w") as f:
        f.write("\n".join(",".join(x) for x in lines) + "\n")
    known = spark.createDataFrame([], "id int, name string, description string, unit_of_measure string, plant_id int, "
                                      "is_active boolean, data_source_id int")
    stored = spark.createDataFrame([], "tag_id int, timestamp timestamp_ntz, value string, frequency string, quality string")
    out = ingest_sheet(spark, path, known, stored)
    row = out.counters.first()
    assert (row.total_values, row.zero_values, row.nan_values, row.missing_tag_values) == (3 * n, n - 1, 3, 0)
    days = sorted(r.timestamp for r in out.inserted.select("timestamp").distinct().collect())
    assert days == [dt.datetime(2024, 5, d) for d in (1, 2, 13)]  # month first throughout
    assert out.inserted.count() == 3 * (n - 1) and not out.held
    small = os.path.join(scratch, "small.csv")
    with open(small, "w") as f:
        f.write("time,a\n,\n,\n13/5/2024,1\n14/5/2024,2\n1/6/2024,3\n")
    have = spark.createDataFrame([(7, "a", "", "", 1, True, 1)], known.schema)
    old = spark.createDataFrame([(7, dt.datetime(2024, 5, 14), "9", "hour", "GOOD")], stored.schema)
    held = ingest_sheet(spark, small, have, old, on_conflict="hold")
    assert held.held and held.inserted.count() == 0 and held.conflicts.count() == 1
    went = ingest_sheet(spark, small, have, old)
    assert sorted(r.timestamp.month for r in went.inserted.collect()) == [5, 6]  # day first: 1 June
    with open(small, "w") as f:
        f.write("time,a\n,\n,\n2024-01-01,\n")
    try:
        ingest_sheet(spark, small, have, old)
        raise AssertionError("an upload without readings must be refused")
    except SheetError:
        pass
