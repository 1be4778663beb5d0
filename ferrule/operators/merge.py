"""Table maintenance as snapshot -> snapshot operators (keep-first merge, updates,
deletes, retention, re-keying).

Spark tables have no primary key; the ``(tag_id, timestamp)`` key of
``time_series`` is enforced here.  Keep-first is an aggregate with ``min_by`` over a packed
row (partial combine on the map side; Spark sorts for it, as the row is not a fixed-width
value), never ``dropDuplicates`` whose survivor is arbitrary and never a window over a whole tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.timebucket import bucket_start, minus_interval, ntz, time_bucket

SERIES_KEY = ("tag_id", "timestamp")


def keep_first(df: DataFrame, keys=SERIES_KEY, order: str = "src_row") -> DataFrame:
    """One row per key: the one with the smallest ``order`` (insert order wins)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(F.min_by(packed, F.col(order)).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def _span(batch: DataFrame, ts: str):
    row = batch.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    return (row["lo"], row["hi"]) if row is not None else (None, None)


def existing_keys(target: DataFrame, batch: DataFrame, keys=SERIES_KEY, ts: str = "timestamp",
                  span=None) -> DataFrame:
    """Keys of ``target`` restricted to the batch's time span (literal bounds prune the scan).
    ``span`` (any ``(lo, hi)`` covering the batch) saves the job that measures it."""
    lo, hi = span if span is not None else _span(batch, ts)
    t = target.select(*keys)
    if lo is not None:
        t = t.filter(F.col(ts).between(ntz(lo), ntz(hi)))
    return t


def merge_append(target: DataFrame, batch: DataFrame, keys=SERIES_KEY, order: str = "src_row",
                 ts: str = "timestamp", span=None) -> tuple[DataFrame, DataFrame]:
    """Append ignoring conflicts (M2): stored row wins, then the first row of the batch.

    Returns ``(inserted, new_snapshot)``; applying the same batch again inserts nothing."""
    first = keep_first(batch, keys, order)
    inserted = first.join(existing_keys(target, batch, keys, ts, span), list(keys), "left_anti")
    cols = [c for c in target.columns]
    snapshot = target.unionByName(inserted.select(*[c for c in cols if c in inserted.columns]),
                                  allowMissingColumns=True)
    return inserted, snapshot


def duplicate_flags(batch: DataFrame, target: DataFrame, keys=SERIES_KEY, ts: str = "timestamp",
                    span=None) -> DataFrame:
    """Every batch row plus ``is_duplicate`` / ``reason`` when its key is already stored."""
    known = existing_keys(target, batch, keys, ts, span).distinct().withColumn("_hit", F.lit(True))
    out = batch.join(known, list(keys), "left")
    dup = F.coalesce(F.col("_hit"), F.lit(False))
    # Fixed value: the reason text.
    return (out.withColumn("is_duplicate", dup)
            .withColumn("reason", F.when(dup, F.lit("Duplicate entry detected.")))
            .drop("_hit"))


def stored_keys_in(batch_keys: DataFrame, target: DataFrame, keys=SERIES_KEY) -> DataFrame:
    """Composite-key membership ``(tag_id, ts) IN (...)`` as a left-semi join."""
    return target.join(batch_keys.select(*keys).distinct(), list(keys), "left_semi")


# ---------------------------------------------------------------------------
# Updates and deletes by key (M4-M7)
# ---------------------------------------------------------------------------

def apply_updates(df: DataFrame, changes: DataFrame, keys, allowed, updated_at=None, ts_col: str = "updated_at",
                  order: str | None = None, given: str | None = None) -> DataFrame:
    """Bulk update: for each key in ``changes`` set the allow-listed fields that the change row
    gives; touched rows get ``updated_at``.

    A field is given when it is not NULL, or, with ``given`` (a column of field names), when it is
    named there, so a field can be set to NULL.  Several change rows of one key are folded
    in ascending ``order``, field by field (the last given value wins); without ``order`` a repeated
    key is an error.  Keys match null-safe."""
    keys = list(keys)
    fields = [c for c in changes.columns if c not in keys and c in allowed]
    present = {c: F.array_contains(given, c) if given else F.col(c).isNotNull() for c in fields}
    if order is None and not changes.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("a change key is repeated; give an order column to fold the changes")
    rank = F.col(order) if order else F.lit(1)
    last = [F.max_by(F.struct(F.col(c)), F.when(present[c], rank)).alias(f"_new_{c}") for c in fields]
    folded = changes.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.lit(True).alias("_touch"), *last)
    out = df
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        match = same if match is None else match & same
    out = out.join(folded, match, "left")
    for c in fields:
        out = out.withColumn(c, F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.{c}")).otherwise(F.col(c)))
    if updated_at is not None and ts_col in df.columns:
        out = out.withColumn(ts_col, F.when(F.col("_touch"), ntz(updated_at)).otherwise(F.col(ts_col)))
    return out.drop("_touch", *[f"_new_{c}" for c in fields], *[f"_key_{k}" for k in keys])


def delete_keys(df: DataFrame, delete: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Delete rows matching the delete-key table.  Returns ``(remaining, deleted)``."""
    keys = list(keys)
    k = delete.select(*keys).distinct()
    return df.join(k, keys, "left_anti"), df.join(k, keys, "left_semi")


def delete_all(df: DataFrame, plant_id=None, plant_col: str = "plant_id") -> DataFrame:
    """Clear a table, or one plant's rows."""
    if plant_id is None:
        return df.limit(0)
    return df.filter(~F.col(plant_col).eqNullSafe(F.lit(plant_id)))  # rows without a plant stay


# ---------------------------------------------------------------------------
# Retention, re-keying
# ---------------------------------------------------------------------------

def retention(df: DataFrame, as_of, keep: str = "3 months", chunk_interval: str = "7 days",
              ts: str = "timestamp", chunk_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop whole chunks older than ``as_of - keep``: a chunk survives while its end is
    after the cutoff.  Returns ``(kept, dropped_chunks)`` where dropped_chunks lists chunk starts.

    The first kept chunk holds the cutoff, so the bound is one literal that reaches the scan.
    Rows without a timestamp belong to no chunk and stay."""
    bound = ntz(bucket_start(chunk_interval, minus_interval(as_of, keep)))
    start = F.col(chunk_col or ts)
    kept = df.filter((start >= bound) | start.isNull())
    dropped = df.filter(start < bound)
    first = F.col(chunk_col) if chunk_col else time_bucket(chunk_interval, ts)
    return kept, dropped.select(first.alias("chunk_start")).distinct()


def rekey(df: DataFrame, drop_cols, keys=SERIES_KEY, order: str = "src_row") -> tuple[DataFrame, DataFrame]:
    """Drop columns and enforce a new key (R3).  Returns ``(rekeyed, collisions)``;
    collisions lists keys that had more than one row, with their row count."""
    base = df.drop(*drop_cols)
    collisions = (base.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    return keep_first(base, keys, order), collisions


# ---------------------------------------------------------------------------
# Range (limit) check
# ---------------------------------------------------------------------------

def _num_text(c):
    """Number rendered without a trailing ``.0`` (``500.0`` -> ``500``)."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def range_check(series: DataFrame, tags: DataFrame, limits: DataFrame, numeric_mode: str = "strict") -> DataFrame:
    """Flag readings outside their tag's ``[min, max]``: ``is_abnormal`` and ``reason``.

    ``limits(tag_name, min, max)`` is joined by tag *name*; readings that are not
    numeric, or whose tag has no limits, are never abnormal."""
    from ferrule.functions.numeric import numeric_value

    t = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"))
    lim = limits.select("tag_name", F.col("min").alias("_min"), F.col("max").alias("_max"))
    out = series.join(t, "tag_id", "left").join(lim, "tag_name", "left")
    num = numeric_value(F.col("value"), numeric_mode)
    bad = F.coalesce((num < F.col("_min")) | (num > F.col("_max")), F.lit(False))
    # Fixed value: the reason text.
    reason = F.format_string("Value %s is outside the allowed range (%s - %s)", F.col("value"),
                             _num_text(F.col("_min")), _num_text(F.col("_max")))
    return (out.withColumn("is_abnormal", bad).withColumn("reason", F.when(bad, reason))
            .drop("_min", "_max"))
