"""Repeated imports (S8) that copy only what changed, by digests of key ranges.

Keys are dealt to ``ranges`` ranges of their hash, so that hot keys and growing ends spread; the target is stored by range.
A digest of a range is its row count and two order-free sums over row hashes.  Digests are kept of the source as it
was imported last and of the target's keys as they were left.  A run computes both sides' digests in one narrow
aggregate each (no row is moved), and only ranges whose digest differs on either side are compared row by row: rows
of other ranges enter no shuffle, and their target folders are not read for it.

Rules: the stored row wins, then the source row with the smallest ``order``; NULL in a key is a value like
any other.  The digests are written after the rows, so a run that stopped is repeated: its ranges differ, and what it
stored already is found by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ferrule.session import cut_lineage

RANGES = 256
_MASK = (1 << 32) - 1
DIGESTS = "part int, side string, rows bigint, folded bigint, summed bigint"


@dataclass
class ImportRun:
    """``inserted`` rows and the ``changed`` ranges of one run."""

    inserted: DataFrame
    changed: list[int]


def _part(keys, ranges: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int").alias("part")


def range_digests(rows: DataFrame, columns, side: str) -> DataFrame:
    """One digest row per range of ``rows`` (with their ``part``) over ``columns``."""
    h = F.xxhash64(*columns)
    return (rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("folded"),
                                     F.sum(h.bitwiseAND(F.lit(_MASK))).alias("summed"))
            .select("part", F.lit(side).alias("side"), "rows", "folded", "summed"))


def _stored(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    from ferrule.sources.storage import _fs

    schema = StructType([*schema.fields, StructField("part", IntegerType())])
    fs, root, jvm = _fs(spark, target)
    if not fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "part=*")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(target)


def _recorded(spark: SparkSession, target: str) -> DataFrame:
    from ferrule.sources.storage import _fs

    path = f"{target.rstrip('/')}/_digests"
    fs, hpath, _ = _fs(spark, path)
    return spark.read.schema(DIGESTS).parquet(path) if fs.exists(hpath) else spark.createDataFrame([], DIGESTS)


def import_changed(source: DataFrame, target: str, keys, order: str, ranges: int = RANGES) -> ImportRun:
    """Copy the rows of ``source`` whose keys the table at ``target`` lacks.

    ``order`` is a column of the source that ranks rows of one key; it is not stored.  ``ranges`` belongs to the target and stays
    the same from run to run."""
    from ferrule.operators.merge import keep_first

    spark, keys = source.sparkSession, list(keys)
    columns = [c for c in source.columns if c != order]
    schema = source.select(*columns).schema
    rows = source.withColumn("part", _part(keys, ranges))
    now = cut_lineage(range_digests(rows, [*columns, order], "source").union(
        range_digests(_stored(spark, target, schema), keys, "target")))
    before = _recorded(spark, target)
    same = F.col("n.part") == F.col("b.part")
    for c in ("side", "rows", "folded", "summed"):
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"b.{c}"))
    differ = now.alias("n").join(before.alias("b"), same, "left_anti").select("part").union(
        before.alias("b").join(now.alias("n"), same, "left_anti").select("part"))
    changed = sorted(r["part"] for r in differ.distinct().collect())  # at most the ranges
    if not changed:
        return ImportRun(source.select(*columns).limit(0), [])
    first = keep_first(rows.where(F.col("part").isin(changed)), ["part", *keys], order)
    stored = _stored(spark, target, schema).where(F.col("part").isin(changed)).select("part", *keys)
    known = F.lit(True)
    for k in ["part", *keys]:
        known = known & F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}"))
    inserted = cut_lineage(first.alias("f").join(stored.alias("s"), known, "left_anti").select("part", *columns))
    (inserted.repartitionByRange("part", *keys).write.mode("append").partitionBy("part").parquet(target))
    spark.catalog.refreshByPath(target)
    left = range_digests(_stored(spark, target, schema).where(F.col("part").isin(changed)), keys, "target")
    kept = now.where(~F.col("part").isin(changed) | (F.col("side") == "source"))
    digests = cut_lineage(kept.union(left))
    digests.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{target.rstrip('/')}/_digests")
    spark.catalog.refreshByPath(f"{target.rstrip('/')}/_digests")
    return ImportRun(inserted.drop("part"), changed)
