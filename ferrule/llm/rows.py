"""Schemas of operators that carry a row of the input beside their own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def whole_row(df: DataFrame) -> Column:
    """A struct of all columns, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def with_fields(fields: list[StructField], ddl: str) -> StructType:
    """A schema of given fields followed by those of a DDL text."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])
