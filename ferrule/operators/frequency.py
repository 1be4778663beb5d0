"""Sampling-frequency detection (consecutive gaps, median ladder) and conflicts.

Scale notes
* Gaps per key are computed in two levels so no window ever holds a whole series:
  ``lag`` inside (key, time block) partitions, plus one boundary gap per
  block from a per-block min/max aggregate whose size is bounded by the time
  span, not by the row count.  A hot tag with a third of all rows is spread
  over all its blocks.
* The whole-file form and the exact medians work on range partitions (``order_stats``): no window is
  keyed by time alone or by nothing, and no buffer of gaps is kept per key.
* The frequency label only depends on where the median gap falls relative to
  the ladder thresholds.  For each threshold ``t`` we aggregate
  ``count(gap < t)``, ``max(gap | gap < t)`` and ``min(gap | gap >= t)``; that
  decides ``median < t`` exactly (including the interpolated even case) and is
  an ordinary partial/final aggregate -- no per-group value buffers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.timebucket import time_bucket, ntz
from ferrule.operators import order_stats

# The frequency ladder, median gap in seconds below each bound.
FREQUENCY_LADDER = (
    (1, "sub_second"),
    (60, "second"),
    (3600, "minute"),
    (86400, "hour"),
    (604800, "day"),
)
TOP_FREQUENCY = "week"

# Frequency -> storage chunk width, and -> rollup bucket name.
CHUNK_INTERVALS = {
    "sub_second": "1 hour",
    "second": "1 day",
    "minute": "7 days",
    "hour": "30 days",
    "day": "180 days",
    "week": "365 days",
}
DEFAULT_CHUNK_INTERVAL = "30 days"
ROLLUP_TABLES = {
    "sub_second": "time_bucket_second",
    "second": "time_bucket_minute",
    "minute": "time_bucket_hour",
    "hour": "time_bucket_day",
    "day": "time_bucket_week",
    "week": "time_bucket_month",
    "month": "time_bucket_year",
}
DEFAULT_ROLLUP_TABLE = "time_bucket_day"


def _seconds_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later).cast("double") / F.lit(1_000_000.0)


def consecutive_gaps(df: DataFrame, keys, ts: str = "timestamp", block: str = "1 hour") -> DataFrame:
    """One row per consecutive pair of (sorted) timestamps per key: ``keys..., gap`` seconds.

    NULL timestamps are dropped first.  Duplicate timestamps give 0-second gaps.
    """
    return _gaps_and_edges(df, keys, ts, block)[0]


def _gaps_and_edges(df: DataFrame, keys, ts: str, block: str):
    keys = list(keys)
    base = df.select(*keys, F.col(ts).alias("_ts")).filter(F.col("_ts").isNotNull())
    base = base.withColumn("_blk", time_bucket(block, "_ts"))
    inner_w = Window.partitionBy(*keys, "_blk").orderBy("_ts")
    inner = (base.withColumn("_prev", F.lag("_ts").over(inner_w))
             .filter(F.col("_prev").isNotNull())
             .select(*keys, _seconds_between(F.col("_prev"), F.col("_ts")).alias("gap")))
    edges = base.groupBy(*keys, "_blk").agg(F.min("_ts").alias("_first"), F.max("_ts").alias("_last"))
    edge_w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_blk")
    boundary = (edges.withColumn("_prev_last", F.lag("_last").over(edge_w))
                .filter(F.col("_prev_last").isNotNull())
                .select(*keys, _seconds_between(F.col("_prev_last"), F.col("_first")).alias("gap")))
    return inner.unionByName(boundary), edges


def _median_below(n: Column, below: Column, lo: Column, hi: Column, t: float) -> Column:
    half = F.floor(n / 2)
    odd = F.pmod(n, F.lit(2)) == 1
    return (F.when(n == 0, F.lit(None).cast("boolean"))
            .when(odd, below >= half + 1)
            .when(below >= half + 1, F.lit(True))
            .when(below <= half - 1, F.lit(False))
            .otherwise((lo + hi) / 2 < F.lit(float(t))))


def frequency_label_aggs(gap: str = "gap", weight: str | None = None):
    """Aggregate expressions deciding the ladder label from a gap column, counted ``weight`` times."""
    g = F.col(gap)
    times = lambda met: F.coalesce(F.sum(F.when(met, F.col(weight) if weight else F.lit(1))), F.lit(0))
    aggs = [times(g.isNotNull()).alias("_n")]
    for i, (t, _) in enumerate(FREQUENCY_LADDER):
        aggs += [
            times(g < t).alias(f"_c{i}"),
            F.max(F.when(g < t, g)).alias(f"_lo{i}"),
            F.min(F.when(g >= t, g)).alias(f"_hi{i}"),
        ]
    return aggs


def frequency_label_from_aggs() -> Column:
    n = F.col("_n")
    expr = F.when(n == 0, F.lit(None).cast("string"))
    for i, (t, label) in enumerate(FREQUENCY_LADDER):
        expr = expr.when(_median_below(n, F.col(f"_c{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}"), t), label)
    return expr.otherwise(TOP_FREQUENCY)


def _helper_cols():
    return ["_n"] + [f"_{p}{i}" for i in range(len(FREQUENCY_LADDER)) for p in ("c", "lo", "hi")]


def frequency_by_key(df: DataFrame, keys, ts: str = "timestamp", block: str = "1 hour") -> DataFrame:
    """Detected frequency per key: ``keys..., gap_count, frequency`` (NULL when < 2 rows)."""
    keys = list(keys)
    gaps, edges = _gaps_and_edges(df, keys, ts, block)
    agg = gaps.groupBy(*keys).agg(*frequency_label_aggs())
    out = agg.withColumn("frequency", frequency_label_from_aggs()).withColumn("gap_count", F.col("_n"))
    # keys with a single row have no gaps: keep them with NULL frequency (the key list
    # comes from the per-block summary, not from another pass over the rows)
    every_key = edges.select(*keys).distinct()
    out = every_key.join(out.drop(*_helper_cols()), keys, "left")
    return out.select(*keys, F.coalesce("gap_count", F.lit(0)).cast("bigint").alias("gap_count"), "frequency")


def frequency_of_frame(df: DataFrame, ts: str = "timestamp", with_span: bool = False) -> DataFrame:
    """Frequency of a whole file (one ordering of all rows): one row ``gap_count, frequency``
    (plus ``lo, hi`` -- the time span, read off the edges of the ranges -- when asked)."""
    gaps, edges = order_stats.consecutive_gaps(df, [], ts)
    agg = gaps.withColumn("gap", F.col("gap_us") / F.lit(1_000_000.0)).agg(*frequency_label_aggs(weight="weight"))
    out = agg.select(F.col("_n").cast("bigint").alias("gap_count"),
                     frequency_label_from_aggs().alias("frequency"))
    if not with_span:
        return out
    span = edges.agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    return out.withColumn("_k", F.lit(1)).join(span.withColumn("_k", F.lit(1)), "_k").drop("_k")


def gap_quantiles_by_key(df: DataFrame, keys, probabilities: dict[str, float], ts: str = "timestamp") -> DataFrame:
    """Exact interpolated quantiles of the gaps (seconds) per key: ``keys..., gap_count`` and a column
    per entry of ``probabilities``.  A key with a single row has no gap and no row."""
    gaps, _ = order_stats.consecutive_gaps(df, keys, ts)
    out = order_stats.weighted_quantiles(gaps, keys, "gap_us", "weight", probabilities)
    return out.select(*keys, F.col("n").alias("gap_count"), *[(F.col(p) / 1e6).alias(p) for p in probabilities])


def median_gap_by_key(df: DataFrame, keys, ts: str = "timestamp") -> DataFrame:
    """Exact (interpolated) median gap in seconds per key, for reporting."""
    return gap_quantiles_by_key(df, keys, {"median_gap": 0.5}, ts).drop("gap_count")


def chunk_interval(frequency: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in CHUNK_INTERVALS.items() for x in kv])
    return F.coalesce(mapping[frequency], F.lit(DEFAULT_CHUNK_INTERVAL))


def rollup_table(frequency: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in ROLLUP_TABLES.items() for x in kv])
    return F.coalesce(mapping[frequency], F.lit(DEFAULT_ROLLUP_TABLE))


def upload_span(upload: DataFrame, ts: str = "timestamp"):
    """``(min, max)`` of an upload's timestamps -- a one-row summary."""
    row = upload.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    return (row["lo"], row["hi"]) if row is not None else (None, None)


def frequency_conflicts(upload_names: DataFrame, span, upload_frequency: str, series: DataFrame,
                        tags: DataFrame) -> DataFrame:
    """Tags of an upload whose stored rows in the upload's time span carry other frequencies (A10).

    ``upload_names``: ``(name)`` of the uploaded tags; ``span``: ``(lo, hi)`` of the upload;
    ``series``: stored ``time_series`` with ``frequency``; ``tags``: ``(id, name)``.
    Output: ``tag_name, existing_frequency, existing_frequencies, new_frequency`` -- one
    job for all tags; the literal span bounds reach the scan as pushed filters.
    """
    lo, hi = span
    empty = "tag_name string, existing_frequency string, existing_frequencies string, new_frequency string"
    if lo is None:
        return series.sparkSession.createDataFrame([], empty)
    names = upload_names.select("name").distinct()
    stored = (series.filter(F.col("timestamp").between(ntz(lo), ntz(hi)))
              .select("tag_id", "frequency")
              .join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
              .join(names, "name", "left_semi"))
    # collect_set is bounded by the number of distinct frequency labels (7)
    per_tag = stored.groupBy("name").agg(F.array_sort(F.collect_set("frequency")).alias("freqs"))
    new = F.lit(upload_frequency).cast("string")  # NULL for an upload of one timestamp: differs from any
    conflicts = per_tag.filter((F.size("freqs") > 0) & ~F.coalesce(F.array_contains("freqs", new), F.lit(False)))
    return conflicts.select(
        F.col("name").alias("tag_name"),
        F.array_min("freqs").alias("existing_frequency"),
        F.array_join("freqs", ",").alias("existing_frequencies"),
        new.alias("new_frequency"),
    )
