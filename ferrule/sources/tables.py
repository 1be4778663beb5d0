"""Parquet table access with explicit column pruning."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Read one parquet table; selecting ``columns`` here lets the scan's ReadSchema shrink."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return df


def row_count(df: DataFrame) -> DataFrame:
    """Row count of a table as a one-row DataFrame (partial counts per task, one tiny final)."""
    from pyspark.sql import functions as F

    return df.agg(F.count(F.lit(1)).alias("row_count"))
