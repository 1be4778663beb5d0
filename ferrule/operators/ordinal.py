"""Dense global ordinals without a single-partition window.

The frame is range-partitioned and sorted on the ordering columns, every row
gets its position inside its partition, and a per-partition offset table
(one row per partition -- its size is bounded by the partition count, not by
the data) turns that into a global position.

The tagged frame is written once (``cut_lineage``) before both uses.  Without
it the offsets and the ids come from two executions of the range exchange
unless Spark reuses it, and range bounds are sampled with a seed derived from
the RDD id; reading one written copy guarantees that offsets and ids agree,
also when a task is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import cut_lineage


def with_global_ordinal(df: DataFrame, order_cols, name: str = "ordinal", start: int = 0,
                        num_partitions: int | None = None) -> DataFrame:
    order_cols = list(order_cols)
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    tagged = cut_lineage(ranged.sortWithinPartitions(*order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    offsets = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = tagged.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
    out = out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first") + F.lit(start)).cast("bigint"))
    return out.drop("_pid", "_mid", "_off", "_first")
