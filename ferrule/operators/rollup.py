"""Rollup tables: a cascade of mergeable states, and refreshes that follow what changed.

States.  A bucket's state holds what its statistics need and what merges: the exact decimal sum and the remainder of
the readings, counts, extremes, and the first and last numeric reading with their times.  The finest
table is built from the series once; every coarser one merges the states of a finer table, which is smaller by
the ratio of the widths, so the series is read a single time for any number of levels.

Ledger.  Merges, deletes and retention write the ``(day, tag_id)`` pairs they touch to a small
table beside the rollup.  A refresh recomputes exactly the touched pairs whose days lie in its window: days are rewritten
with the other tags' rows as they were, a day without rows is removed, and pairs outside the window stay
in the ledger.  The ledger's entries are removed only after the rollup is written, so a refresh that
stops half-way is repeated by the next one.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.numeric import numeric_decimal, numeric_value
from ferrule.functions.timebucket import bucket_start, ntz, parse_interval, time_bucket
from ferrule.operators.frequency import DEFAULT_ROLLUP_TABLE, ROLLUP_TABLES
from ferrule.session import cut_lineage

# The bucket of every rollup table.
TABLE_BUCKETS = {
    "time_bucket_second": "1 second",
    "time_bucket_minute": "1 minute",
    "time_bucket_hour": "1 hour",
    "time_bucket_day": "1 day",
    "time_bucket_week": "1 week",
    "time_bucket_month": "1 month",
    "time_bucket_year": "1 year",
}
LEDGER_SCHEMA = "day date, tag_id int, entry string"
ROLLUP_FIELDS = "tag_id int, bucket timestamp_ntz, avg_value double, sample_count bigint, day date"


# --- mergeable states ---------------------------------------------------------------------

def partial_states(series: DataFrame, interval: str, numeric_mode: str = "strict") -> DataFrame:
    """The state of every ``(tag_id, bucket)`` of a series.

    Of several readings at a bucket's first (last) time the smallest (largest) counts as first (last)."""
    num, dec = numeric_value("value", numeric_mode), numeric_decimal("value", numeric_mode)
    at = F.when(num.isNotNull(), F.struct(F.col("timestamp").alias("time"), num.alias("value")))
    return (series.groupBy("tag_id", time_bucket(interval, "timestamp").alias("bucket"))
            .agg(F.try_sum(dec).alias("whole"), F.sum(num - F.coalesce(dec.cast("double"), F.lit(0.0))).alias("rest"),
                 F.sum(num).alias("plain"), F.count(num).alias("numeric"), F.count(dec).alias("exact"),
                 F.min(num).alias("min_value"), F.max(num).alias("max_value"), F.min(at).alias("first"), F.max(at).alias("last"),
                 F.count(F.lit(1)).alias("sample_count")))


def merge_states(states: DataFrame, interval: str) -> DataFrame:
    """States of finer buckets merged into buckets of ``interval``."""
    lost = F.max((F.col("whole").isNull() & (F.col("exact") > 0)).cast("int"))  # a sum beyond the decimal type
    return (states.groupBy("tag_id", time_bucket(interval, "bucket").alias("bucket"))
            .agg(F.when(lost == 0, F.try_sum("whole")).alias("whole"),
                 *[F.sum(c).alias(c) for c in ("rest", "plain", "numeric", "exact")],
                 F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
                 F.min("first").alias("first"), F.max("last").alias("last"), F.sum("sample_count").alias("sample_count")))


def finished(states: DataFrame) -> DataFrame:
    """``tag_id, bucket, avg_value, min_value, max_value, first_value, last_value, sample_count`` of states."""
    total = F.coalesce(F.col("whole").cast("double"), F.lit(0.0)) + F.coalesce("rest", F.lit(0.0))
    sound = F.col("whole").isNotNull() | (F.col("exact") == 0)
    average = F.when(F.col("numeric") > 0, F.when(sound, total / F.col("numeric")).otherwise(F.col("plain") / F.col("numeric")))
    return states.select("tag_id", "bucket", average.alias("avg_value"), "min_value", "max_value",
                         F.col("first.value").alias("first_value"), F.col("last.value").alias("last_value"), "sample_count")


def nests(fine: str, coarse: str) -> bool:
    """Whether every bucket of ``coarse`` is a whole number of buckets of ``fine``."""
    a, b = parse_interval(fine), parse_interval(coarse)
    if a.is_monthly:
        return b.is_monthly and b.months % a.months == 0
    if b.is_monthly:  # months begin at midnight; fixed buckets line up with days only below and at a day
        return 86_400_000_000 % a.micros == 0
    return b.micros % a.micros == 0


def build_cascade(series: DataFrame, path: str, tables=tuple(TABLE_BUCKETS), numeric_mode: str = "strict") -> dict[str, str]:
    """Write the state tables ``path/<table>`` for the named rollup tables and return their paths.

    Each table is merged from the coarsest finer one that nests in it (the smallest such table); the finest is the only one that
    reads the series."""
    wanted = sorted(tables, key=list(TABLE_BUCKETS).index)
    done: dict[str, str] = {}
    spark = series.sparkSession
    for table in wanted:
        interval = TABLE_BUCKETS[table]
        finer = [t for t in done if nests(TABLE_BUCKETS[t], interval)]
        states = (merge_states(spark.read.parquet(done[finer[-1]]), interval) if finer
                  else partial_states(series, interval, numeric_mode))
        target = f"{path.rstrip('/')}/{table}"
        states.repartitionByRange("tag_id", "bucket").sortWithinPartitions("tag_id", "bucket").write.mode("overwrite").parquet(target)
        done[table] = target
    return done


def read_rollup(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The statistics of one table of a cascade."""
    return finished(spark.read.parquet(f"{path.rstrip('/')}/{table}"))


def rollup_for(spark: SparkSession, path: str, frequency: str | None) -> DataFrame:
    """The rollup that serves data of a sampling frequency (S14): its table, read from the cascade."""
    return read_rollup(spark, path, ROLLUP_TABLES.get(frequency, DEFAULT_ROLLUP_TABLE))


# --- a ledger of touched days ---------------------------------------------------------------

def _ledger(path: str) -> str:
    return f"{path.rstrip('/')}/_touched"


def _exists(spark: SparkSession, path: str) -> bool:
    from ferrule.sources.storage import _fs

    fs, hpath, _ = _fs(spark, path)
    return fs.exists(hpath)


def record_touched(rows: DataFrame, rollup: str) -> None:
    """Enter the ``(day, tag_id)`` pairs of changed rows (with ``tag_id`` and ``timestamp``) into the ledger of a rollup."""
    entry = uuid.uuid4().hex
    (rows.where(F.col("timestamp").isNotNull())
     .select(F.to_date("timestamp").alias("day"), F.col("tag_id").cast("int").alias("tag_id")).distinct()
     .withColumn("entry", F.lit(entry)).write.mode("append").partitionBy("entry").parquet(_ledger(rollup)))


def touched(spark: SparkSession, rollup: str) -> DataFrame:
    """The ledger: ``day, tag_id, entry``."""
    if not _exists(spark, _ledger(rollup)):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(_ledger(rollup))


def _same_pair(a: str, b: str) -> Column:
    return F.col(f"{a}.day").eqNullSafe(F.col(f"{b}.day")) & F.col(f"{a}.tag_id").eqNullSafe(F.col(f"{b}.tag_id"))


def refresh_touched(series: DataFrame, path: str, as_of, start_offset: str = "1 month", end_offset: str = "1 hour",
                    numeric_mode: str = "strict") -> DataFrame:
    """Refresh a daily rollup (A6) from its ledger: the touched pairs whose whole day lies in ``[as_of - start_offset, as_of -
    end_offset]`` are recomputed from ``series``.  Returns the pairs that were refreshed.

    ``series`` is the snapshot after the changes.  Entries that arrive while this runs are left to the next refresh."""
    from ferrule.operators.metrics import daily_rollup, refresh_window
    from ferrule.sources.storage import _fs

    spark = series.sparkSession
    lo, hi = refresh_window(as_of, start_offset, end_offset)
    first_day, end_day = bucket_start("1 day", lo), bucket_start("1 day", hi)
    last = end_day.date() - dt.timedelta(days=1)
    seen = cut_lineage(touched(spark, path))
    due = F.col("day").between(F.lit(first_day.date()), F.lit(last))
    pairs = cut_lineage(seen.where(due).select("day", "tag_id").distinct())
    days = [r["day"] for r in pairs.select("day").distinct().collect()]  # at most the days of the window
    if days:
        fresh = series.where((F.col("timestamp") >= ntz(first_day)) & (F.col("timestamp") < ntz(end_day))).withColumn(
            "day", F.to_date("timestamp")).alias("s").join(pairs.alias("p"), _same_pair("s", "p"), "left_semi")
        fresh = daily_rollup(fresh.drop("day"), numeric_mode).withColumn("day", F.to_date("bucket"))
        kept = read_daily(spark, path).where(F.col("day").isin(days)).alias("k").join(pairs.alias("p"), _same_pair("k", "p"), "left_anti")
        names = ["tag_id", "bucket", "avg_value", "sample_count", "day"]
        out = cut_lineage(kept.select(*names).union(fresh.select(*names)))
        (out.repartitionByRange("day", "tag_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(path))
        filled = {r["day"] for r in out.select("day").distinct().collect()}
        fs, root, jvm = _fs(spark, path)
        for day in set(days) - filled:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"day={day.isoformat()}"), True)
    _settle(spark, path, seen, due)
    spark.catalog.refreshByPath(path)
    return pairs


def _settle(spark: SparkSession, path: str, seen: DataFrame, due: Column) -> None:
    """Take what a refresh has seen out of the ledger; pairs outside its window are entered anew first."""
    from ferrule.sources.storage import _fs

    later = seen.where(~due)
    if not later.isEmpty():
        (later.select("day", "tag_id").distinct().withColumn("entry", F.lit(uuid.uuid4().hex))
         .write.mode("append").partitionBy("entry").parquet(_ledger(path)))
    fs, root, jvm = _fs(spark, _ledger(path))
    for row in seen.select("entry").distinct().collect():  # one per change since the last refresh
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"entry={row['entry']}"), True)


def stored_days(spark: SparkSession, path: str) -> set[dt.date]:
    """Days that have a folder in a stored daily rollup."""
    from ferrule.sources.storage import _fs

    fs, root, jvm = _fs(spark, path)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "day=*")) or []
    return {dt.date.fromisoformat(item.getPath().getName()[len("day="):]) for item in found}


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The stored daily rollup, with its ``day``; empty where nothing is stored yet."""
    if not stored_days(spark, path):
        return spark.createDataFrame([], ROLLUP_FIELDS)
    return spark.read.schema(ROLLUP_FIELDS).parquet(path)
