"""Scalar expressions: numeric rule, buckets, timestamp parsing, display names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ferrule.functions.numeric import numeric_value
from ferrule.functions.text import clean_icon_name, default_icon, display_name, icon_short_name
from ferrule.functions.timebucket import minus_interval, parse_interval, parse_timestamp_text, time_bucket

VALUES = ["1", "1.5", "0", "-1", "1e3", ".5", "NaN", "BAD", "", None]


def test_strict_numeric(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = [r[0] for r in df.select(numeric_value("v")).collect()]
    assert got == [1.0, 1.5, 0.0, None, None, None, None, None, None, None]


def test_signed_numeric(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = [r[0] for r in df.select(numeric_value("v", "signed")).collect()]
    assert got == [1.0, 1.5, 0.0, -1.0, None, None, None, None, None, None]


@pytest.mark.parametrize("text,expected", [
    ("2024-11-29 08:00:00", dt.datetime(2024, 11, 29, 8)),
    ("2024-11-29", dt.datetime(2024, 11, 29)),
    ("29/11/2024 08:00:00", dt.datetime(2024, 11, 29, 8)),
    ("29/11/2024", dt.datetime(2024, 11, 29)),
    ("11/29/2024 08:00:00", dt.datetime(2024, 11, 29, 8)),
    ("11/29/2024", dt.datetime(2024, 11, 29)),
    ("5/1/2024", dt.datetime(2024, 1, 5)),
    ("2024-11-29T08:00:00Z", dt.datetime(2024, 11, 29, 8)),
    ("not a time", None),
])
def test_timestamp_formats(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_timestamp_text("t")).first()[0] == expected


def _py_bucket(ts, width_s):
    origin = dt.datetime(2000, 1, 3)
    off = int((ts - origin).total_seconds())
    return origin + dt.timedelta(seconds=off - off % width_s)


@pytest.mark.parametrize("interval,width", [("1 hour", 3600), ("15 minutes", 900), ("7 days", 604800),
                                            ("5 days", 432000), ("1 week", 604800)])
def test_fixed_buckets_align_to_monday_2000(spark, interval, width):
    stamps = [dt.datetime(2024, 1, 1, 0, 7), dt.datetime(1999, 12, 31, 23, 59), dt.datetime(2023, 6, 15, 13, 45, 1)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    got = [r[0] for r in df.select(time_bucket(interval, "ts")).collect()]
    assert got == [_py_bucket(s, width) for s in stamps]


def test_month_buckets(spark):
    stamps = [dt.datetime(2024, 5, 17), dt.datetime(1999, 11, 2), dt.datetime(1992, 1, 1)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    assert [r[0] for r in df.select(time_bucket("3 months", "ts")).collect()] == [
        dt.datetime(2024, 4, 1), dt.datetime(1999, 10, 1), dt.datetime(1992, 1, 1)]
    assert [r[0] for r in df.select(time_bucket("1 year", "ts")).collect()] == [
        dt.datetime(2024, 1, 1), dt.datetime(1999, 1, 1), dt.datetime(1992, 1, 1)]


def test_interval_parse():
    assert parse_interval("1 hour").micros == 3_600_000_000
    assert parse_interval("3 months").months == 3
    assert parse_interval("day").micros == 86_400_000_000
    with pytest.raises(ValueError):
        parse_interval("2 fortnights")
    assert minus_interval("2024-05-31 00:00:00", "3 months") == dt.datetime(2024, 2, 29)


@pytest.mark.parametrize("raw,expected", [
    ("o'neil 3d-pump", "O'Neil 3D Pump"),
    ("https_id", "HTTPs ID"),
    ("Identity", "IDentity"),
    ("flow_kg", "Flow KG"),
    ("MIDDLE EAST", "Middle East"),
    ("json_api_url", "JSON API URL"),
])
def test_display_name(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "c string")
    assert df.select(display_name("c")).first()[0] == expected


def test_icons_and_names(spark):
    df = spark.createDataFrame([("Main Pump 3",), ("Cooling Tower",), ("Widget",)], "c string")
    assert [r[0] for r in df.select(default_icon("c")).collect()] == ["zap", "snowflake", "file"]
    df = spark.createDataFrame([("my icon!*.svg",), ("pump_1234abcd.svg",), ("valve.svg",)], "c string")
    assert [r[0] for r in df.select(clean_icon_name("c")).collect()] == ["myiconsvg", "pump_1234abcdsvg", "valvesvg"]
    assert [r[0] for r in df.select(icon_short_name("c")).collect()] == ["my icon!*", "pump", "valve"]


def test_iso_bounds_in_range_filter(spark):
    from ferrule.operators.metrics import time_range

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10),), (dt.datetime(2024, 1, 1, 12),)], "timestamp timestamp_ntz")
    got = time_range(df, "2024-01-01T09:00:00Z", "2024-01-01T11:00:00+02:00").collect()
    assert [r[0] for r in got] == [dt.datetime(2024, 1, 1, 10)]


def test_exact_avg_and_fallback(spark):
    from ferrule.functions.numeric import exact_avg

    df = spark.createDataFrame([("g", v) for v in ["0.1", "0.2", "0.3", "BAD", "-5"]] +
                               [("h", "1" + "0" * 30), ("h", "1")], "k string, v string")
    got = {r.k: r.a for r in df.groupBy("k").agg(exact_avg("v").alias("a")).collect()}
    assert got["g"] == 0.6 / 3  # exact decimal sum 0.6, then one double division
    assert got["h"] == (1e30 + 1) / 2  # beyond decimal(38,10): double fallback
