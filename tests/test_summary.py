"""Chunk summaries against scans, and compaction beside appends."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from ferrule.operators import frequency as FQ
from ferrule.operators import metrics as M
from ferrule.sources import storage as S
from ferrule.sources import summary as Y

BASE = dt.datetime(2024, 1, 1)
SERIES = "tag_id int, timestamp timestamp_ntz, value string, frequency string"


def rows(seed, n=300, days=40):
    r = random.Random(seed)
    return [(r.choice([1, 2, 3]), BASE + dt.timedelta(seconds=r.randrange(days * 86400)), "1", r.choice(["hour", "minute", None])) for _ in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, SERIES).repartition(3)


def tags(spark):
    return spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], "id int, name string, plant_id int")


def same(a, b):
    assert sorted((tuple(r) for r in a.collect()), key=str) == sorted((tuple(r) for r in b.collect()), key=str)


def scan(spark, path):
    return S.read_series(spark, path).select("tag_id", "timestamp", "value", "frequency")


def counts(df):
    return df.groupBy("tag_id").agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def test_summary_follows_the_layout(spark, scratch):
    lay = scratch + "/l"
    S.write_series(frame(spark, rows(1)), lay, interval="7 days", mode="overwrite", with_summary=True)
    check = lambda: same(Y.layout_counts(spark, lay).drop("chunks"), counts(scan(spark, lay)))
    check()
    S.merge_into_layout(spark, lay, frame(spark, rows(1, 50) + rows(2)).withColumn("src_row", F.lit(1)), "1 day")
    check()
    same(Y.history_of_layout(spark, lay, tags(spark), plant_id=1), M.upload_history(scan(spark, lay), tags(spark), plant_id=1))
    S.delete_from_layout(spark, lay, scan(spark, lay).where(F.dayofmonth("timestamp").between(3, 9)))
    check()
    S.compact_chunks(spark, lay, "2024-01-20 00:00:00")
    check()
    S.drop_expired_chunks(spark, lay, "2024-02-15 00:00:00", "1 month")
    check()
    assert not Y._exists(spark, Y._mark(lay))


@pytest.mark.parametrize("span", [(BASE, BASE + dt.timedelta(days=40)), (BASE + dt.timedelta(days=8, hours=3), BASE + dt.timedelta(days=8, hours=4)),
                                  (BASE + dt.timedelta(days=100), BASE + dt.timedelta(days=101))])
def test_conflicts_equal_the_scan(spark, scratch, span):
    lay = scratch + "/l"
    S.write_series(frame(spark, rows(3)), lay, interval="7 days", mode="overwrite", with_summary=True)
    names = spark.createDataFrame([("a",), ("b",), ("nope",)], "name string")
    same(Y.conflicts_of_layout(spark, lay, names, span, "day", tags(spark)),
         FQ.frequency_conflicts(names, span, "day", scan(spark, lay), tags(spark)))


def test_no_series_file_is_read(spark, scratch):
    lay = scratch + "/l"
    S.write_series(frame(spark, rows(4)), lay, interval="7 days", mode="overwrite", with_summary=True)
    want = counts(scan(spark, lay)).collect()
    shutil.move(lay + "/plant_id=1", scratch + "/away")
    assert sorted(map(tuple, Y.layout_counts(spark, lay).drop("chunks").collect())) == sorted(map(tuple, want))
    assert Y.history_of_layout(spark, lay, tags(spark)).count() > 0
    names = spark.createDataFrame([("a",)], "name string")
    assert Y.conflicts_of_layout(spark, lay, names, (BASE, BASE + dt.timedelta(days=60)), "day", tags(spark)).count() == 1


@pytest.mark.parametrize("start, end, tag_ids", [(None, None, None), (BASE + dt.timedelta(days=5), BASE + dt.timedelta(days=33, hours=5), None),
                                                 (None, BASE + dt.timedelta(days=20), [2]), (BASE + dt.timedelta(days=90), None, None)])
def test_newest_rows_come_from_the_newest_chunks(spark, scratch, start, end, tag_ids):
    lay = scratch + "/l"
    S.write_series(frame(spark, rows(10)), lay, interval="1 day", mode="overwrite", with_summary=True)
    S.write_series(frame(spark, rows(11, 20)), lay, interval="7 days")
    whole = S.read_series(spark, lay, start, end, tag_ids)
    for limit in (1, 25, 1000):
        got = Y.latest_of_layout(spark, lay, start, end, limit, tag_ids)
        want = M.latest_readings(whole, limit=limit)
        assert [r["timestamp"] for r in got.collect()] == [r["timestamp"] for r in want.collect()]
    if start is None:  # all older chunks may be gone
        since = Y.newest_bound(spark, lay, None, end, 25, tag_ids)
        want = [r["timestamp"] for r in Y.latest_of_layout(spark, lay, None, end, 25, tag_ids).collect()]
        import glob

        gone = [f for f in glob.glob(lay + "/plant_id=1/width=*/chunk=*")
                if int(f.rsplit("=", 1)[1]) + int(f.split("width=")[1].split("/")[0]) <= S._seconds(since)]
        for f in gone:
            shutil.move(f, scratch + "/" + f.rsplit("/", 1)[1] + f.split("width=")[1].split("/")[0])
        assert len(gone) > 5
        assert [r["timestamp"] for r in Y.latest_of_layout(spark, lay, None, end, 25, tag_ids).collect()] == want


def test_a_write_that_stopped_is_found(spark, scratch, monkeypatch):
    lay = scratch + "/l"
    S.write_series(frame(spark, rows(5)), lay, interval="7 days", mode="overwrite", with_summary=True)
    with monkeypatch.context() as m:
        m.setattr(Y, "write_states", lambda *a, **k: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            S.write_series(frame(spark, rows(6)), lay, interval="7 days")
    same(Y.layout_counts(spark, lay).drop("chunks"), counts(scan(spark, lay)))


def test_rows_appended_during_a_compaction_stay(spark, scratch, monkeypatch):
    lay = scratch + "/l"
    S.write_series(frame(spark, rows(7)), lay, interval="7 days", mode="overwrite")
    S.write_series(frame(spark, rows(8)), lay, interval="7 days")
    before = scan(spark, lay).count()
    finish, calls = S._finish_compaction, []

    def appending(*a):
        calls.append(a)
        if len(calls) == 2:  # the rewritten files and the plan are there, nothing is exchanged yet
            S.write_series(frame(spark, rows(9)), lay, interval="7 days")
        finish(*a)

    monkeypatch.setattr(S, "_finish_compaction", appending)
    S.compact_chunks(spark, lay, "2024-03-01 00:00:00")
    assert len(calls) == 2 and scan(spark, lay).count() == before + 300


@pytest.mark.parametrize("stop", ["before plan", "after plan"])
def test_a_compaction_that_stopped_is_resumed(spark, scratch, monkeypatch, stop):
    lay = scratch + "/l"
    S.write_series(frame(spark, rows(7)), lay, interval="7 days", mode="overwrite")
    S.write_series(frame(spark, rows(8)), lay, interval="7 days")
    want = sorted(map(str, scan(spark, lay).collect()))
    finish, calls = S._finish_compaction, []

    def failing(*a):
        calls.append(a)
        if len(calls) == 2:
            if stop == "before plan":
                shutil.rmtree(lay + "/_compaction")
            raise OSError("stopped")
        finish(*a)

    with monkeypatch.context() as m:
        m.setattr(S, "_finish_compaction", failing)
        with pytest.raises(OSError):
            S.compact_chunks(spark, lay, "2024-03-01 00:00:00")
    assert sorted(map(str, scan(spark, lay).collect())) == want
    S.compact_chunks(spark, lay, "2024-03-01 00:00:00")
    assert sorted(map(str, scan(spark, lay).collect())) == want
