"""Time-bucket analytics over ``time_series(tag_id, timestamp, value, ...)``.

Every function returns a lazy DataFrame.  Aggregations are hash aggregates
with map-side partial combine keyed on ``(tag_id, bucket)``, so a hot tag is
spread over all of its buckets.  Gap filling and carry-forward never hold a
whole tag in one task: the spine is generated in blocks of buckets and locf
runs inside ``(tag_id, block)`` windows plus a small per-block carry table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.numeric import exact_avg, numeric_value
from ferrule.functions.timebucket import date_trunc, parse_interval, time_bucket

SPINE_BLOCK = 4096  # buckets per spine block / locf window partition


# ---------------------------------------------------------------------------
# Filters (F1, F2, F3)
# ---------------------------------------------------------------------------

def _bound(v):
    """ISO-8601 text bounds lose a ``Z`` / ``+hh:mm`` suffix (wall clock kept)."""
    from ferrule.functions.timebucket import iso_bound

    return iso_bound(v) if isinstance(v, str) else v


def time_range(df: DataFrame, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Inclusive ``[start, end]``; bounds are literals so Parquet min/max pruning applies."""
    start, end = _bound(start), _bound(end)
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def tag_filter(df: DataFrame, tag_ids=None, tag_col: str = "tag_id") -> DataFrame:
    """``tag_id = ANY(ids)``: a literal IN list, or a left-semi join for a DataFrame of ids."""
    if tag_ids is None:
        return df
    if isinstance(tag_ids, DataFrame):
        return df.join(tag_ids.select(F.col(tag_ids.columns[0]).alias(tag_col)).distinct(), tag_col, "left_semi")
    if isinstance(tag_ids, (int, str)):
        tag_ids = [tag_ids]
    return df.filter(F.col(tag_col).isin(list(tag_ids)))


def latest_readings(df: DataFrame, start=None, end=None, limit: int = 100, ts: str = "timestamp",
                    tiebreak=("tag_id",)) -> DataFrame:
    """Newest first, top ``limit`` (TakeOrderedAndProject: per-task top-k, then merge)."""
    out = time_range(df, start, end, ts)
    order = [F.col(ts).desc()] + [F.col(c).asc() for c in tiebreak if c in df.columns]
    return out.orderBy(*order).limit(limit)


# ---------------------------------------------------------------------------
# Bucket metrics (A1, A2, A3, A5)
# ---------------------------------------------------------------------------

def _num(mode: str) -> Column:
    return numeric_value(F.col("value"), mode)


def _stats(mode: str, with_first_last: bool = False):
    num = _num(mode)
    aggs = [
        exact_avg(F.col("value"), mode).alias("avg_value"),
        F.min(num).alias("min_value"),
        F.max(num).alias("max_value"),
    ]
    if with_first_last:
        # first/last numeric reading by time; non-numeric readings are skipped
        order = F.when(num.isNotNull(), F.col("timestamp"))
        aggs += [F.min_by(num, order).alias("first_value"), F.max_by(num, order).alias("last_value")]
    aggs.append(F.count(F.lit(1)).alias("sample_count"))
    return aggs


def bucket_metrics(series: DataFrame, interval: str = "1 hour", start=None, end=None, tag_ids=None,
                   numeric_mode: str = "strict", with_first_last: bool = False,
                   ordered: bool = False) -> DataFrame:
    """avg/min/max of numeric readings and ``COUNT(*)`` per ``(tag_id, bucket)``."""
    df = tag_filter(time_range(series, start, end), tag_ids)
    out = (df.groupBy("tag_id", time_bucket(interval, "timestamp").alias("bucket"))
           .agg(*_stats(numeric_mode, with_first_last)))
    return out.orderBy("tag_id", "bucket") if ordered else out


def trunc_metrics(series: DataFrame, unit: str = "hour", start=None, end=None, tag_ids=None,
                  numeric_mode: str = "strict", ordered: bool = False) -> DataFrame:
    """Truncation variant: calendar units only (``hour``, ``day``, ``week``, ``month`` ...)."""
    df = tag_filter(time_range(series, start, end), tag_ids)
    out = (df.groupBy("tag_id", date_trunc(unit, "timestamp").alias("bucket"))
           .agg(*_stats(numeric_mode)))
    return out.orderBy("tag_id", "bucket") if ordered else out


def first_last(series: DataFrame, interval: str = "1 day", start=None, end=None, tag_ids=None,
               numeric_mode: str = "strict") -> DataFrame:
    """First and last numeric reading by time per bucket."""
    df = tag_filter(time_range(series, start, end), tag_ids)
    num = _num(numeric_mode)
    order = F.when(num.isNotNull(), F.col("timestamp"))
    return (df.groupBy("tag_id", time_bucket(interval, "timestamp").alias("bucket"))
            .agg(F.min_by(num, order).alias("first_value"),
                 F.max_by(num, order).alias("last_value"),
                 F.min(order).alias("first_time"),
                 F.max(order).alias("last_time")))


# ---------------------------------------------------------------------------
# Gap fill + carry forward
# ---------------------------------------------------------------------------

def gapfill_spine(bounds: DataFrame, interval: str, block: int = SPINE_BLOCK) -> DataFrame:
    """Every bucket start between ``first_bucket`` and ``last_bucket`` per ``tag_id``.

    Generated in blocks of ``block`` buckets so no single row carries a huge array,
    and redistributed by (tag_id, block) before the inner explode.
    """
    iv = parse_interval(interval)
    if iv.is_monthly:
        months = lambda c: (F.year(c) * 12 + F.month(c))
        n = months(F.col("last_bucket")) - months(F.col("first_bucket"))
        n = (n / iv.months).cast("bigint") + 1
    else:
        n = (F.timestamp_diff("MICROSECOND", F.col("first_bucket"), F.col("last_bucket"))
             / F.lit(iv.micros)).cast("bigint") + 1
    blocks = (bounds.withColumn("_n", n)
              .withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                        F.floor((F.col("_n") - 1) / block).cast("bigint"))))
              .repartition("tag_id", "_blk"))
    idx = blocks.withColumn("_i", F.explode(F.sequence(
        F.col("_blk") * block, F.least(F.col("_blk") * block + block, F.col("_n")) - 1)))
    if iv.is_monthly:
        bucket = F.add_months(F.col("first_bucket"), (F.col("_i") * iv.months).cast("int")).cast("timestamp_ntz")
    else:
        bucket = F.timestamp_add("MICROSECOND", F.col("_i") * F.lit(iv.micros), F.col("first_bucket"))
    return idx.select("tag_id", bucket.alias("bucket"), F.col("_blk").alias("bucket_block"))


def carry_forward(df: DataFrame, value: str, out: str, key: str = "tag_id", order: str = "bucket",
                  block: str = "bucket_block") -> DataFrame:
    """locf: last non-NULL ``value`` at or before each row, per ``key``.

    Two levels: inside ``(key, block)`` windows, then a carry from earlier
    blocks taken from a per-block aggregate (one row per block).
    """
    w_in = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_loc", F.last(value, ignorenulls=True).over(w_in))
    per_block = (df.groupBy(key, block)
                 .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("_blk_last")))
    w_blk = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.withColumn("_carry", F.last("_blk_last", ignorenulls=True).over(w_blk)).drop("_blk_last")
    return (local.join(carry, [key, block], "left")
            .withColumn(out, F.coalesce(F.col("_loc"), F.col("_carry")))
            .drop("_loc", "_carry"))


def gapfilled_metrics(series: DataFrame, interval: str = "1 hour", start=None, end=None, tag_ids=None,
                      numeric_mode: str = "strict", ordered: bool = False) -> DataFrame:
    """avg/min/max/first/last/count per bucket with empty buckets filled and ``interpolated``
    = locf(avg).  The spine runs from ``bucket(start)`` to ``bucket(end)`` when bounds are
    given, else from each tag's first to last bucket.  Filled buckets: NULL stats, count 0."""
    from ferrule.session import cut_lineage

    iv = parse_interval(interval)
    # the bucket aggregate feeds the bounds, the spine join and the carry: written once
    # (it is far smaller than the raw series) instead of re-reading the series three times
    agg = cut_lineage(bucket_metrics(series, iv, start, end, tag_ids, numeric_mode, with_first_last=True))
    if start is not None and end is not None:
        b0 = time_bucket(iv, F.lit(start).cast("timestamp_ntz"))
        b1 = time_bucket(iv, F.lit(end).cast("timestamp_ntz"))
        bounds = agg.select("tag_id").distinct().select("tag_id", b0.alias("first_bucket"), b1.alias("last_bucket"))
    else:
        bounds = agg.groupBy("tag_id").agg(F.min("bucket").alias("first_bucket"),
                                           F.max("bucket").alias("last_bucket"))
    spine = gapfill_spine(bounds, iv)
    filled = spine.join(agg, ["tag_id", "bucket"], "left")
    filled = filled.withColumn("sample_count", F.coalesce("sample_count", F.lit(0)).cast("bigint"))
    filled = carry_forward(filled, "avg_value", "interpolated_value")
    out = filled.select("tag_id", "bucket", "avg_value", "min_value", "max_value", "first_value",
                        "last_value", "sample_count", "interpolated_value")
    return out.orderBy("tag_id", "bucket") if ordered else out


# ---------------------------------------------------------------------------
# Rollups and reports
# ---------------------------------------------------------------------------

def daily_rollup(series: DataFrame, numeric_mode: str = "strict", start=None, end=None) -> DataFrame:
    """Per tag and 1-day bucket: avg numeric reading and sample count."""
    df = time_range(series, start, end)
    return (df.groupBy("tag_id", time_bucket("1 day", "timestamp").alias("bucket"))
            .agg(exact_avg(F.col("value"), numeric_mode).alias("avg_value"),
                 F.count(F.lit(1)).alias("sample_count")))


def refresh_window(as_of, start_offset: str = "1 month", end_offset: str = "1 hour"):
    """Bounds of the rolling rollup refresh: ``[as_of - start_offset, as_of - end_offset]``."""
    from ferrule.functions.timebucket import minus_interval

    return minus_interval(as_of, start_offset), minus_interval(as_of, end_offset)


def upload_history(series: DataFrame, tags: DataFrame, plant_id=None, limit: int = 20) -> DataFrame:
    """Per (tag name, frequency): count, first and last reading; newest first, top ``limit``."""
    t = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"), "plant_id")
    if plant_id is not None:
        t = t.filter(F.col("plant_id") == plant_id)
    out = (series.select("tag_id", "timestamp", "frequency").join(t.drop("plant_id"), "tag_id")
           .groupBy("tag_name", "frequency")
           .agg(F.count(F.lit(1)).alias("records_count"),
                F.min("timestamp").alias("first_record"),
                F.max("timestamp").alias("last_record")))
    return out.orderBy(F.col("last_record").desc(), "tag_name", "frequency").limit(limit)


def tag_statistics(series: DataFrame, tags: DataFrame, tag_ids=None, start=None, end=None,
                   gapfill: bool = False, keep_empty: bool = False) -> DataFrame:
    """Per tag and day: data points, first/last timestamp, daily count.

    Tags without rows in the range drop out (the range predicate is on the series side, which
    makes the outer join inner); ``keep_empty`` keeps them with a NULL day.  ``gapfill`` gives every tag
    that has rows every day of the requested bounds (of its own rows where a bound is not given)."""
    t = tag_filter(tags.select(F.col("id").alias("tag_id"), F.col("name"), F.col("unit_of_measure")),
                   tag_ids)
    s = tag_filter(time_range(series.select("tag_id", "timestamp", "value"), start, end), tag_ids)
    day = time_bucket("1 day", "timestamp")
    out = (s.join(t, "tag_id").groupBy("tag_id", "name", "unit_of_measure", day.alias("day"))
           .agg(F.count("value").alias("data_points"),
                F.min("timestamp").alias("first_timestamp"),
                F.max("timestamp").alias("last_timestamp"),
                F.count("value").alias("daily_count")))
    if gapfill:
        from ferrule.functions.timebucket import bucket_start, ntz

        edge = lambda given, own: ntz(bucket_start("1 day", given)) if given is not None else own
        bounds = out.groupBy("tag_id").agg(F.min("day").alias("_lo"), F.max("day").alias("_hi")).select(
            "tag_id", edge(start, F.col("_lo")).alias("first_bucket"), edge(end, F.col("_hi")).alias("last_bucket"))
        spine = gapfill_spine(bounds, "1 day").drop("bucket_block").withColumnRenamed("bucket", "day")
        out = spine.join(t, "tag_id").join(out.drop("name", "unit_of_measure"), ["tag_id", "day"], "left")
    elif keep_empty:
        out = t.join(out.drop("name", "unit_of_measure"), "tag_id", "left")
    return (out.withColumn("data_points", F.coalesce("data_points", F.lit(0)))
            .withColumn("daily_count", F.coalesce("daily_count", F.lit(0))))


def refresh_daily_rollup(series: DataFrame, path: str, as_of, start_offset: str = "1 month",
                         end_offset: str = "1 hour", numeric_mode: str = "strict") -> tuple:
    """Materialised daily rollup (A6): recompute the whole days in
    ``[as_of - start_offset, as_of - end_offset]`` and replace exactly those day partitions
    (dynamic partition overwrite); a day of the window that has no rows any more is removed, older days
    stay as written, and a day that is not over at the end offset is left to a later refresh.
    Returns the refreshed window bounds.  ``rollup.refresh_touched`` recomputes only what changed."""
    from ferrule.functions.timebucket import bucket_start, ntz
    from ferrule.session import cut_lineage
    from ferrule.sources.storage import drop_days

    lo, hi = refresh_window(as_of, start_offset, end_offset)
    first_day, end_day = bucket_start("1 day", lo), bucket_start("1 day", hi)
    window = series.filter((F.col("timestamp") >= ntz(first_day)) & (F.col("timestamp") < ntz(end_day)))
    out = cut_lineage(daily_rollup(window, numeric_mode).withColumn("day", F.date_format("bucket", "yyyy-MM-dd")))
    filled = {r["day"] for r in out.select("day").distinct().collect()}  # at most the days of the window
    (out.repartitionByRange("day", "tag_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
    drop_days(series.sparkSession, path, first_day.date().isoformat(), end_day.date().isoformat(), keep=filled)
    return lo, hi
