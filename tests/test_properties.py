"""Randomised properties (many cases per Spark job)."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from ferrule.functions.timebucket import time_bucket
from ferrule.operators import frequency as FQ
from ferrule.operators import hierarchy as H
from ferrule.operators import metrics as M
from ferrule.operators.ingest import melt

LADDER = [(1, "sub_second"), (60, "second"), (3600, "minute"), (86400, "hour"), (604800, "day")]


def _label(median):
    if median is None or pd.isna(median):
        return None
    for t, name in LADDER:
        if median < t:
            return name
    return "week"


def test_frequency_label_equals_pandas_median(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    choices = [0, 0.5, 1, 30, 59, 60, 61, 1800, 3599, 3600, 3601, 43200, 86399, 86400, 90000, 604799, 604800, 1e6]
    for key in range(300):
        n = rng.randint(1, 12)
        t = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 10**6))
        stamps = [t]
        for _ in range(n - 1):
            t = t + dt.timedelta(seconds=rng.choice(choices))
            stamps.append(t)
        rng.shuffle(stamps)
        rows += [(key, s) for s in stamps]
        s = pd.Series(sorted(stamps))
        expected[key] = _label(s.diff().dt.total_seconds().median())
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    got = {r.k: r.frequency for r in FQ.frequency_by_key(df, ["k"], "ts").collect()}
    assert got == expected


def test_time_bucket_matches_python(spark):
    rng = random.Random(11)
    stamps = [dt.datetime(1995, 1, 1) + dt.timedelta(seconds=rng.randint(0, 40 * 365 * 86400),
                                                     microseconds=rng.randint(0, 999999)) for _ in range(500)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    widths = {"1 second": 1, "15 minutes": 900, "1 hour": 3600, "6 hours": 21600, "1 day": 86400,
              "3 days": 259200, "7 days": 604800}
    out = df.select("ts", *[time_bucket(k, "ts").alias(f"b{i}") for i, k in enumerate(widths)]).collect()
    origin = dt.datetime(2000, 1, 3)
    for r in out:
        for i, w in enumerate(widths.values()):
            off = (r.ts - origin) // dt.timedelta(microseconds=1)
            want = origin + dt.timedelta(microseconds=off - off % (w * 1_000_000))
            assert r[f"b{i}"] == want
    months = df.select("ts", time_bucket("2 months", "ts").alias("m")).collect()
    for r in months:
        idx = (r.ts.year - 2000) * 12 + r.ts.month - 1
        idx -= idx % 2
        assert r.m == dt.datetime(2000 + idx // 12, idx % 12 + 1, 1)


def _py_parse(paths):
    """Independent model of the path-list semantics."""
    seen, out = set(), []
    for p in paths:
        if p is None:
            continue
        parts = [c.strip() for c in p.split(":") if c.strip()]
        for i in range(len(parts)):
            key = ":".join(parts[: i + 1])
            if key not in seen:
                seen.add(key)
                out.append((key, parts[i], parts[i - 1] if i else None, len(out)))
    return out


def test_parse_paths_matches_model(spark):
    rng = random.Random(3)
    words = ["Plant", "Area", " Pump", "Valve ", "", "Tank", "Mixer"]
    paths = []
    for _ in range(400):
        k = rng.randint(0, 5)
        p = ":".join(rng.choice(words) for _ in range(k))
        paths.append(rng.choice([p, ":" + p, p + ":", None if rng.random() < 0.05 else p]))
    df = spark.createDataFrame(list(enumerate(paths)), "src_row long, path string")
    got = sorted((r.path, r.label, r.parent_label, r.display_order) for r in H.parse_paths(df).collect())
    assert got == sorted(_py_parse(paths))


def test_integrity_clean_on_level_consistent_paths(spark):
    # labels belong to one level each (a label may sit under several parents of that level)
    rng = random.Random(4)
    vocab = [[f"L{lvl}_{w}" for w in range(3 + lvl)] for lvl in range(5)]
    paths = [":".join(rng.choice(vocab[i]) for i in range(rng.randint(1, 5))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(paths)), "src_row long, path string")
    nodes = H.parse_paths(df)
    assert nodes.count() == len({":".join(p.split(":")[: i + 1]) for p in paths for i in range(len(p.split(":")))})
    assert H.integrity_report(nodes)[1].first().is_valid


def test_melt_rows_equal_non_null_cells(spark):
    rng = random.Random(5)
    n_tags = 6
    rows = []
    for i in range(300):
        cells = [rng.choice([None, "0", "1.5", "x", None]) for _ in range(n_tags)]
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), cells))
    schema = "_line long, timestamp timestamp_ntz, cells array<string>"
    df = spark.createDataFrame(rows, schema)
    non_null = sum(c is not None for r in rows for c in r[2])
    assert melt(df, [f"tag{i}" for i in range(n_tags)]).count() == non_null


def test_stream_rollups_equal_the_batch_rollup(spark):
    """The closed form on the days the watermark has closed, the live form on all days."""
    from ferrule.plans.queries import q_daily_rollup_closed, q_daily_rollup_stream
    from ferrule.sources import adapters as A

    sf = "/root/testdata/sf0.001"
    series = A.series_by_type(spark, sf)
    wm = series.agg(F.max("timestamp")).first()[0] - dt.timedelta(hours=1)
    batch = M.daily_rollup(series)
    closed = batch.filter(F.col("bucket") + F.expr("INTERVAL 1 DAY") <= F.lit(wm))
    rows = lambda df: sorted((r.tag_id, r.bucket, round(r.avg_value or 0, 6), r.sample_count) for r in df.collect())
    assert rows(closed) == rows(q_daily_rollup_closed(spark, sf)) and closed.count() > 0
    assert rows(batch) == rows(q_daily_rollup_stream(spark, sf))
