"""Distributed order statistics: consecutive gaps and exact quantiles without a window over a series.

Both work on range partitions.  Rows are sorted over ranges of ``(keys, value)``, so a range is bounded by the
partition size however the rows spread over keys: a hot key spans many ranges and a small one shares its range.
What crosses a border is one edge row per range and key, at most two ranges' worth for every key but those that span
several -- never more than the keys plus the partitions.

* ``consecutive_gaps`` collapses a series to distinct times with their counts (partial aggregate, so a hot
  timestamp is one row), and takes the gap to the time before inside the range; the first time of a range
  takes it from the edge of the range before.
* ``weighted_quantiles`` finds the ranges that hold the wanted ranks from cumulative counts per range, and
  only there counts row by row.  No buffer of values is kept per key.

The sorted frame is written once (``cut_lineage``): range bounds are sampled, so a second execution could cut
elsewhere.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import cut_lineage

RANGE = "_range"


def sorted_ranges(df: DataFrame, columns) -> DataFrame:
    """``df`` sorted over ranges of ``columns``, written, with the number of the range in ``_range``."""
    columns = list(columns)
    return cut_lineage(df.repartitionByRange(*columns).sortWithinPartitions(*columns)
                       .withColumn(RANGE, F.spark_partition_id()))


def _same(left: str, right: str, keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _range_before(edges: DataFrame) -> DataFrame:
    """``(_range, _before)`` of the ranges that have rows: a row per range, so as many as partitions."""
    ranges = sorted(r[RANGE] for r in edges.select(RANGE).distinct().collect())
    return edges.sparkSession.createDataFrame(list(zip(ranges[1:], ranges[:-1], strict=True)), f"{RANGE} int, _before int")


def consecutive_gaps(df: DataFrame, keys, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Gaps between consecutive timestamps per key: ``keys..., gap_us, weight``, and the edges ``keys...,
    _range, first, last``.

    NULL timestamps are dropped; ``m`` equal timestamps give ``m - 1`` gaps of zero.  ``keys`` may be empty (one
    ordering of the whole frame) and hold NULL keys, which are a series of their own."""
    keys = list(keys)
    times = (df.select(*keys, F.col(ts).alias("_ts")).where(F.col("_ts").isNotNull())
             .groupBy(*keys, "_ts").agg(F.count(F.lit(1)).alias("_m")))
    ranged = sorted_ranges(times, [*keys, "_ts"])
    inside = Window.partitionBy(RANGE, *keys).orderBy("_ts")
    micros = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    near = (ranged.withColumn("_prev", F.lag("_ts").over(inside)).where(F.col("_prev").isNotNull())
            .select(*keys, micros(F.col("_prev"), F.col("_ts")).alias("gap_us"), F.lit(1).cast("bigint").alias("weight")))
    equal = ranged.where("_m > 1").select(*keys, F.lit(0).cast("bigint").alias("gap_us"), (F.col("_m") - 1).alias("weight"))
    edges = ranged.groupBy(RANGE, *keys).agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"))
    if not keys:  # a row per range: the borders are read off on the driver
        rows = sorted(tuple(r) for r in edges.collect())
        steps = [((b[1] - a[2]) // dt.timedelta(microseconds=1), 1) for a, b in zip(rows, rows[1:], strict=False)]
        spark = df.sparkSession
        across = spark.createDataFrame(steps, "gap_us bigint, weight bigint")
        return near.union(equal).union(across), spark.createDataFrame(rows, f"{RANGE} int, first timestamp_ntz, last timestamp_ntz")
    edges = cut_lineage(edges)
    before = edges.join(F.broadcast(_range_before(edges)), RANGE)  # as many rows as partitions
    across = (before.alias("b").join(edges.alias("a"), (F.col(f"a.{RANGE}") == F.col("b._before")) & _same("a", "b", keys))
              .select(*[F.col(f"b.{k}") for k in keys], micros(F.col("a.last"), F.col("b.first")).alias("gap_us"),
                      F.lit(1).cast("bigint").alias("weight")))
    return near.union(equal).union(across), edges


def weighted_quantiles(df: DataFrame, keys, value: str, weight: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key of ``value`` counted ``weight`` times: ``keys..., n`` and a double column
    per entry of ``probabilities`` (name -> probability).

    The quantile at ``p`` of ``n`` values lies ``frac`` between the values of ranks ``floor(p (n - 1))`` and the next.
    NULL values are not counted; a key without a value has no row.  Values of one key are distinct rows after the first
    sum, so any number of repeats costs one row."""
    keys = list(keys)
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
               .agg(F.sum(weight).cast("bigint").alias("_w")))
    ranged = sorted_ranges(counted, [*keys, "_v"])
    # one row per range and key, with what lies before it in the key
    per_range = cut_lineage(ranged.groupBy(RANGE, *keys).agg(F.sum("_w").alias("_count")))
    order = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(RANGE)
    per_range = (per_range.withColumn("_before", F.sum("_count").over(order) - F.col("_count"))
                 .withColumn("_n", F.sum("_count").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    at = [F.struct(F.lit(name).alias("name"), F.floor(p * (F.col("_n") - 1)).cast("bigint").alias("low"),
                   (p * (F.col("_n") - 1) - F.floor(p * (F.col("_n") - 1))).alias("frac")) for name, p in probabilities.items()]
    wanted = per_range.withColumn("_q", F.explode(F.array(*at))).select(
        RANGE, *keys, "_before", "_n", "_count", F.col("_q.name").alias("_name"), F.col("_q.frac").alias("_frac"),
        F.explode(F.array(F.col("_q.low"), F.when(F.col("_q.frac") > 0, F.col("_q.low") + 1))).alias("_rank"))
    wanted = cut_lineage(wanted.where(F.col("_rank").isNotNull() & (F.col("_rank") >= F.col("_before"))
                                      & (F.col("_rank") < F.col("_before") + F.col("_count"))))
    # rows of the ranges that hold a wanted rank, counted one by one
    holding = wanted.select(RANGE, *keys, "_before").distinct()
    both = lambda a, b: (F.col(f"{a}.{RANGE}") == F.col(f"{b}.{RANGE}")) & _same(a, b, keys)
    rows = ranged.alias("r").join(holding.alias("h"), both("r", "h")).select("r.*", F.col("h._before"))
    inside = Window.partitionBy(RANGE, *keys).orderBy("_v")
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_w").over(inside)).withColumn("_begin", F.col("_end") - F.col("_w"))
    hit = (rows.alias("r").join(wanted.alias("w"), both("r", "w") & (F.col("w._rank") >= F.col("r._begin"))
                                & (F.col("w._rank") < F.col("r._end")))
           .select(*[F.col(f"r.{k}") for k in keys], "w._n", "w._name", "w._frac", "w._rank", F.col("r._v").cast("double").alias("_v")))
    out = []
    for name in probabilities:
        mine = F.col("_name") == name
        low, high = F.min(F.when(mine, F.struct("_rank", "_v"))), F.max(F.when(mine, F.struct("_rank", "_v")))
        frac = F.max(F.when(mine, F.col("_frac")))
        # the middle of two is their plain mean; other fractions move from the lower value
        out.append(F.when(frac == 0.5, (low["_v"] + high["_v"]) / 2).otherwise(low["_v"] + (high["_v"] - low["_v"]) * frac).alias(name))
    return hit.groupBy(*keys).agg(F.max("_n").alias("n"), *out)
