"""Live rollup and keep-first ingest over several micro-batches."""

import datetime as dt
import os

from pyspark.sql import functions as F

from ferrule.streaming import keep_first_batch_writer, run_keep_first_ingest, run_live_rollup
from ferrule.streaming import keys as K

SERIES = "tag_id int, timestamp timestamp_ntz, value string"
ROWS = SERIES + ", src_row long"
T0 = dt.datetime(2024, 1, 1)


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


def upload(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_open_days_are_published_and_replaced(spark, scratch):
    src, sink, ck = (os.path.join(scratch, x) for x in ("src", "out", "ck"))

    def run(rows):
        upload(spark, src, rows, SERIES)
        out = run_live_rollup(spark, src, SERIES, lambda d: d, sink, ck)
        return {(r.tag_id, r.bucket.day): (r.avg_value, r.sample_count) for r in out.collect()}

    first = run([(1, at(1, 5), "2"), (1, at(1, 6), "4"), (2, at(1, 7), "BAD"), (1, at(2, 10), "1"), (2, at(2, 11), "8")])
    assert first == {(1, 1): (3.0, 2), (2, 1): (None, 1), (1, 2): (1.0, 1), (2, 2): (8.0, 1)}
    # a late row within the watermark changes exactly one published row
    second = run([(1, at(2, 10), "3")])
    assert second == {**first, (1, 2): (2.0, 2)}
    # a closed day stays as it was; the next day opens
    third = run([(1, at(1, 8), "100"), (3, at(3, 1), "5")])
    assert third == {**second, (3, 3): (5.0, 1)}


def test_uploads_of_two_widths_see_each_other(spark, scratch):
    """A run with one chunk width and a replay with another store every key once."""
    src, target = (os.path.join(scratch, x) for x in ("src", "tgt"))
    rows = [(t, at(d, 3), f"{d}", 10 * d + t) for d in range(1, 11) for t in (1, 2)]
    upload(spark, src, rows, ROWS)
    for k, width in enumerate(("1 day", "7 days", "30 days")):
        run_keep_first_ingest(spark, src, ROWS, lambda d: d, target, os.path.join(scratch, f"ck{k}"), chunk_interval=width) if k == 0 else \
            keep_first_batch_writer(target, chunk_interval=width)(spark.createDataFrame([(a, b, "again", d) for a, b, _, d in rows], ROWS), k)
    stored = spark.read.parquet(target)
    assert stored.count() == 20 and stored.where("value = 'again'").count() == 0


def test_three_batches_keep_first(spark, scratch):
    """The same key in every upload: the first stays, also when a batch is replayed."""
    target = os.path.join(scratch, "tgt")
    batches = [[(1, T0, "a", 1), (2, T0, "b", 2)], [(1, T0, "late", 3), (3, T0, "c", 4), (3, T0, "c2", 5)],
               [(3, T0, "no", 6), (4, at(20, 1), "d", 7), (None, T0, "n", 8), (5, None, "none", 9)]]
    for k, (rows, width) in enumerate(zip(batches, ("1 day", "7 days", "1 day"), strict=True)):
        df = spark.createDataFrame(rows, ROWS)
        keep_first_batch_writer(target, chunk_interval=width)(df, k)
        keep_first_batch_writer(target, chunk_interval=width)(df, k)
    got = sorted(((r.tag_id, r.value) for r in spark.read.parquet(target).collect()), key=str)
    assert got == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "n")]


def test_stored_side_is_not_shuffled(spark, scratch):
    rows = spark.createDataFrame([(k % 7, T0 + dt.timedelta(hours=k)) for k in range(500)], "tag_id int, timestamp timestamp_ntz")
    table = K.KeyTable(spark, os.path.join(scratch, "tgt"), buckets=6)
    table.add(rows.where(F.hour("timestamp") < 12), 0)
    known = table.known(rows, T0, T0 + dt.timedelta(hours=500), 1)
    assert known.count() == rows.where(F.hour("timestamp") < 12).count()
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") - plan.count("BroadcastExchange") >= 1
    right = plan[plan.index("Bucketed: true") - 2000:] if "Bucketed: true" in plan else plan
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 6 out of 6" in right
    # one shuffle: that of the batch
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan
    # only the chunks of the span are scanned
    assert table.known(rows, T0, T0, 1).count() <= 12 * 7


def test_files_of_the_key_table_stay_bounded(spark, scratch):
    table = K.KeyTable(spark, os.path.join(scratch, "tgt"), buckets=2)
    for k in range(30):
        rows = spark.createDataFrame([(k, T0), (k, T0 + dt.timedelta(hours=1))], "tag_id int, timestamp timestamp_ntz")
        table.add(rows, k)
    files = table._files()
    assert len(files) == 1 and all(K._deltas(f) <= K.MAX_DELTAS for f in files.values())
    assert sum(len(f) for f in files.values()) <= K.MAX_DELTAS * 2
    assert table.stored(T0, T0 + dt.timedelta(days=1), -1).distinct().count() == 60
