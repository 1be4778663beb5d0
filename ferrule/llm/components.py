"""Connected components of an edge table, by minimum labels with pointer jumping.

Every round joins the edges with the labels (keyed shuffles, AQE splits hot keys), lowers each label to the
smallest among the neighbours' and hooks it to that label's own label, then writes the labels to the shared
folder.  Nothing is collected but one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``edges(a bigint, b bigint)`` -> ``(id, component)`` for every id that has an edge; the
    component is the smallest id reachable."""
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("other"))
        lowest = (both.join(of_b, "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
                  .join(labels, "id").select("id", F.least("other", "component").alias("hook"),
                                             F.col("component").alias("old")))
        top = labels.select(F.col("id").alias("hook"), F.col("component").alias("up"))
        step = cut_lineage(lowest.join(top, "hook", "left").select(
            "id", F.least("hook", F.coalesce("up", "hook")).alias("component"), "old"))
        moved = step.where(F.col("component") != F.col("old")).limit(1).count()
        labels = step.select("id", "component")
        if not moved:
            return labels
