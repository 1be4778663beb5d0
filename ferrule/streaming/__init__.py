"""Structured Streaming twins of the incremental behaviours.

* ``daily_rollup_stream`` (ST1): continuous per-tag daily average with a
  1-hour watermark.  ``run_live_rollup`` publishes every day as it grows and replaces its rows when they
  change (update mode, upsert by key); ``run_daily_rollup`` gives a day out once it is closed.
* ``keep_first_batch_writer`` (ST2): micro-batches appended to a stored table
  with the exact cross-batch keep-first rule on ``(tag_id, timestamp)``, held against a bucketed key table.

Checkpoints and sink folders live under the session's shared checkpoint folder
unless the caller passes explicit locations.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.numeric import exact_avg
from ferrule.session import ensure_checkpoint_dir

ROLLUP_SCHEMA = "tag_id int, bucket timestamp_ntz, avg_value double, sample_count bigint"


def _scratch(spark: SparkSession, kind: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{kind}-{uuid.uuid4().hex[:12]}")


def daily_rollup_stream(stream: DataFrame, watermark: str = "1 hour", numeric_mode: str = "strict") -> DataFrame:
    """Streaming ``tag_id, bucket, avg_value, sample_count`` per 1-day window.

    A watermark needs a TIMESTAMP (not NTZ) column.  The NTZ wall clock is mapped to the
    instant with the same UTC reading (exact micros, independent of the session time
    zone), windows are aligned on UTC days, and the window start is mapped back."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ets = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("timestamp")))
    agg = (stream.withColumn("_ets", ets).withWatermark("_ets", watermark)
           .groupBy(F.window("_ets", "1 day").alias("w"), "tag_id")
           .agg(exact_avg(F.col("value"), numeric_mode).alias("avg_value"),
                F.count(F.lit(1)).alias("sample_count")))
    bucket = F.timestamp_add("MICROSECOND", F.unix_micros(F.col("w.start")), epoch)
    return agg.select("tag_id", bucket.alias("bucket"), "avg_value", "sample_count")


def run_daily_rollup(spark: SparkSession, source_dir: str, schema, to_series, sink: str | None = None,
                     checkpoint: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Run ST1 with ``availableNow`` over a Parquet folder and return the sink contents.

    ``to_series`` maps the raw stream to ``time_series`` columns (tag_id, timestamp, value)."""
    sink = sink or _scratch(spark, "rollup-out")
    checkpoint = checkpoint or _scratch(spark, "rollup-ckpt")
    raw = spark.readStream.schema(schema).parquet(source_dir)
    q = (daily_rollup_stream(to_series(raw), watermark).writeStream.outputMode("append")
         .format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(ROLLUP_SCHEMA).parquet(sink)


def rollup_upsert(path: str):
    """``foreachBatch`` function of the update mode: the batch's ``(tag_id, bucket)`` rows replace the stored ones.

    The table is laid out by day; only the days of the batch are read and rewritten.  A replayed batch writes the
    same rows again."""
    from ferrule.operators.rollup import read_daily, stored_days
    from ferrule.session import cut_lineage

    names = ["tag_id", "bucket", "avg_value", "sample_count", "day"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(batch.withColumn("day", F.to_date("bucket")).select(*names))
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # days a micro-batch changed
        if not days:
            return
        out, old = rows, set(days) & stored_days(spark, path)
        if old:
            stored = read_daily(spark, path).where(F.col("day").isin(sorted(old))).alias("s")
            same = F.col("s.tag_id").eqNullSafe(F.col("r.tag_id")) & (F.col("s.bucket") == F.col("r.bucket"))
            kept = stored.join(rows.alias("r"), same, "left_anti").select(*names)
            out = cut_lineage(kept.union(rows))  # the days are overwritten: read them to the end first
        (out.repartitionByRange("day", "tag_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(path))

    return write


def run_live_rollup(spark: SparkSession, source_dir: str, schema, to_series, sink: str | None = None,
                    checkpoint: str | None = None, watermark: str = "1 hour", max_files_per_trigger: int | None = None) -> DataFrame:
    """Run ST1 with ``availableNow`` and published open days; returns the stored rollup.

    A day appears with its first reading and is replaced whenever it changes, until the watermark closes it; readings
    that come later than the watermark allows change nothing.  The state holds open days only."""
    from ferrule.operators.rollup import read_daily

    sink = sink or _scratch(spark, "live-rollup")
    checkpoint = checkpoint or _scratch(spark, "live-rollup-ckpt")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (daily_rollup_stream(to_series(reader.parquet(source_dir)), watermark).writeStream.outputMode("update")
         .foreachBatch(rollup_upsert(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    spark.catalog.refreshByPath(sink)
    return read_daily(spark, sink).drop("day")


def keep_first_batch_writer(target: str, keys=("tag_id", "timestamp"), order: str = "src_row",
                            chunk_interval: str = "7 days"):
    """``foreachBatch`` function: keep-first inside the batch, drop keys already stored,
    append the survivors.

    The target is laid out as ``width=<seconds>/chunk=<start>/batch=<id>``, so batches of several chunk
    widths share it.  Stored keys are looked up in the target's key table (``keys.KeyTable``), which has a width of its
    own; the target itself is not listed.  A replayed micro-batch does not see its own keys and rewrites exactly its own
    ``batch=<id>`` partitions (dynamic overwrite), so replays are idempotent.  Rows without a timestamp are dropped: they
    have no key."""
    from ferrule.functions.timebucket import parse_interval
    from ferrule.operators.merge import keep_first
    from ferrule.session import cut_lineage
    from ferrule.sources.storage import with_chunk
    from ferrule.streaming.keys import KeyTable

    keys = list(keys)
    ts = keys[1]
    width = parse_interval(chunk_interval).micros // 1_000_000

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = cut_lineage(keep_first(batch.where(F.col(ts).isNotNull()), keys, order))
        span = first.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        if span is None or span["lo"] is None:
            return
        types = {f.name: f.dataType.simpleString() for f in first.schema.fields if f.name in keys}
        table = KeyTable(spark, target, keys, types)
        known = table.known(first, span["lo"], span["hi"], batch_id)
        same = [F.col(f"f.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
        new = first.alias("f").join(known.alias("k"), same[0] & same[1], "left_anti")
        new = cut_lineage(with_chunk(new, chunk_interval, ts).withColumn("width", F.lit(width).cast("bigint"))
                          .withColumn("batch", F.lit(batch_id)))
        (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("width", "chunk", "batch").parquet(target))
        table.add(new, batch_id)

    return write


def bounded_dedup_stream(stream: DataFrame, watermark: str = "1 hour", keys=("tag_id", "timestamp")) -> DataFrame:
    """Bounded-state alternative to the exact ST2 writer: ``dropDuplicatesWithinWatermark``
    keeps state only within the watermark delay.  The survivor of a duplicate pair is
    whichever arrives first in the stream (not the smallest source row), and duplicates
    further apart than the delay are not detected -- documented trade-off."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ets = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("timestamp")))
    return (stream.withColumn("_ets", ets).withWatermark("_ets", watermark)
            .dropDuplicatesWithinWatermark(list(keys)).drop("_ets"))


def run_keep_first_ingest(spark: SparkSession, source_dir: str, schema, to_rows, target: str | None = None,
                          checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                          chunk_interval: str = "7 days") -> DataFrame:
    """Run ST2 with ``availableNow``; returns the stored table (all batches)."""
    target = target or _scratch(spark, "ingest-target")
    checkpoint = checkpoint or _scratch(spark, "ingest-ckpt")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = to_rows(reader.parquet(source_dir))
    q = (rows.writeStream.foreachBatch(keep_first_batch_writer(target, chunk_interval=chunk_interval))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(target).drop("batch", "chunk", "width")
