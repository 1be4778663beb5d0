"""Rollup cascade and the ledger of touched days."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import metrics as M
from ferrule.operators import rollup as R
from ferrule.sources import storage as S

BASE = dt.datetime(2024, 1, 1)
SERIES = "tag_id int, timestamp timestamp_ntz, value string"


def series(spark, rows):
    return spark.createDataFrame(rows, SERIES).repartition(4)


def readings(seed=1, n=600):
    r = random.Random(seed)
    values = ["1", "2.5", "0", "-3", "BAD", None, "0.00000000000123", "99999999999999999999999999999.5", "7"]
    return [(r.choice([1, 2, None]), BASE + dt.timedelta(seconds=r.randrange(90 * 86400)), r.choice(values)) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("table", ["time_bucket_hour", "time_bucket_day", "time_bucket_week", "time_bucket_month", "time_bucket_year"])
def test_cascade_equals_direct_aggregates(spark, scratch, table):
    rows = readings()
    df = series(spark, rows)
    R.build_cascade(df, scratch + "/c", ["time_bucket_minute", "time_bucket_hour", "time_bucket_day", table])
    got = R.read_rollup(spark, scratch + "/c", table)
    want = M.bucket_metrics(df, R.TABLE_BUCKETS[table], with_first_last=True)
    key = lambda r: (str(r["tag_id"]), r["bucket"])
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for c in ("tag_id", "bucket", "min_value", "max_value", "first_value", "last_value", "sample_count"):
            assert a[c] == b[c], c
        assert (a["avg_value"] is None) == (b["avg_value"] is None)
        assert a["avg_value"] is None or math.isclose(a["avg_value"], b["avg_value"], rel_tol=1e-12)


def test_series_is_read_once(spark, scratch):
    """Only the finest table comes from the series; the others scan a finer table."""
    series(spark, readings()).write.parquet(scratch + "/raw")
    paths = R.build_cascade(spark.read.schema(SERIES).parquet(scratch + "/raw"), scratch + "/c")
    import shutil

    shutil.move(scratch + "/raw", scratch + "/gone")
    week = R.merge_states(spark.read.parquet(paths["time_bucket_day"]), "1 week")
    assert rows_of(R.finished(week)) == rows_of(R.read_rollup(spark, scratch + "/c", "time_bucket_week"))


def test_weeks_are_not_built_into_months():
    assert R.nests("1 day", "1 month") and R.nests("1 month", "1 year") and R.nests("1 minute", "1 week")
    assert not R.nests("1 week", "1 month") and not R.nests("1 month", "1 week") and not R.nests("1 week", "1 year")


def test_table_of_a_frequency(spark, scratch):
    df = series(spark, readings())
    R.build_cascade(df, scratch + "/c", ["time_bucket_minute", "time_bucket_hour", "time_bucket_day"])
    assert rows_of(R.rollup_for(spark, scratch + "/c", "minute")) == rows_of(R.read_rollup(spark, scratch + "/c", "time_bucket_hour"))
    assert rows_of(R.rollup_for(spark, scratch + "/c", None)) == rows_of(R.read_rollup(spark, scratch + "/c", "time_bucket_day"))


def days(n, tag=1):
    return [(tag, BASE + dt.timedelta(days=d, hours=h), str(d + h)) for d in range(n) for h in (1, 5)]


def stored(spark, path):
    return S.read_series(spark, path).select("tag_id", "timestamp", "value")


def direct(spark, path, before):
    return rows_of(M.daily_rollup(stored(spark, path).where(F.col("timestamp") < F.lit(before).cast("timestamp_ntz"))))


def held(spark, path):
    return rows_of(R.read_daily(spark, path).drop("day"))


def test_refresh_follows_merges_deletes_and_retention(spark, scratch):
    lay, roll = scratch + "/l", scratch + "/r"
    S.write_series(series(spark, days(20) + days(20, None)), lay, interval="1 day", mode="overwrite")
    R.record_touched(stored(spark, lay), roll)
    R.refresh_touched(stored(spark, lay), roll, "2024-01-15 12:00:00")
    assert held(spark, roll) == direct(spark, lay, "2024-01-15")
    # fifteen days lose all their rows of one tag, one day loses everything
    gone = stored(spark, lay).where((F.col("tag_id") == 1) & (F.dayofmonth("timestamp") <= 5) | (F.dayofmonth("timestamp") == 7) & (F.hour("timestamp") > 0))
    S.delete_from_layout(spark, lay, gone.where("tag_id is not null"), roll)
    S.merge_into_layout(spark, lay, series(spark, [(2, BASE + dt.timedelta(days=8), "5")]).withColumn("src_row", F.lit(1)), "7 days", rollup=roll)
    pairs = R.refresh_touched(stored(spark, lay), roll, "2024-01-15 12:00:00")
    assert {(r["day"].day, r["tag_id"]) for r in pairs.collect()} == {*[(d, 1) for d in range(1, 6)], (7, 1), (9, 2)}
    assert held(spark, roll) == direct(spark, lay, "2024-01-15")
    # what the window left out stayed in the ledger
    R.refresh_touched(stored(spark, lay), roll, "2024-01-25 12:00:00")
    assert held(spark, roll) == direct(spark, lay, "2024-01-25")
    assert R.refresh_touched(stored(spark, lay), roll, "2024-01-25 12:00:00").count() == 0
    # retention: the dropped days leave the rollup too
    S.drop_expired_chunks(spark, lay, "2024-02-10 00:00:00", "1 month", rollup=roll)
    R.refresh_touched(stored(spark, lay), roll, "2024-01-25 12:00:00")
    assert held(spark, roll) == direct(spark, lay, "2024-01-25") and min(r[1] for r in held(spark, roll)) >= dt.datetime(2024, 1, 9)


def test_a_refresh_that_stopped_is_repeated(spark, scratch, monkeypatch):
    lay, roll = scratch + "/l", scratch + "/r"
    S.write_series(series(spark, days(4)), lay, interval="1 day", mode="overwrite")
    R.record_touched(stored(spark, lay), roll)
    with monkeypatch.context() as m:
        m.setattr(R, "_settle", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            R.refresh_touched(stored(spark, lay), roll, "2024-01-25 12:00:00")
    assert R.refresh_touched(stored(spark, lay), roll, "2024-01-25 12:00:00").count() == 4
    assert held(spark, roll) == direct(spark, lay, "2024-01-25") and R.touched(spark, roll).count() == 0


def test_window_refresh_removes_days_without_rows(spark, scratch):
    path = scratch + "/w"
    M.refresh_daily_rollup(series(spark, days(20)), path, "2024-01-25 12:00:00")
    M.refresh_daily_rollup(series(spark, days(20)).where(F.dayofmonth("timestamp") <= 5), path, "2024-01-25 12:00:00")
    assert spark.read.parquet(path).count() == 5
