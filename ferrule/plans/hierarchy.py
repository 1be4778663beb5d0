"""Hierarchy upload flow: path list -> validated nodes -> replaced plant hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ferrule.operators import hierarchy as H


def upload_hierarchy(paths: DataFrame, existing: DataFrame, plant_id=None, path_col: str = "path",
                     row_col: str = "src_row"):
    """Parse, validate and swap in a plant's hierarchy.

    Returns ``(nodes, table_after, summary)`` where the one-row summary carries
    ``total_rows, valid_paths, invalid_paths, deleted, created``.  Nothing is replaced
    when the parsed nodes fail validation (``replace_hierarchy`` raises)."""
    nodes = H.parse_paths(paths, path_col, row_col)
    after, counts = H.replace_hierarchy(existing, nodes, plant_id)
    summary = H.one_row_join(H.path_summary(paths, path_col), counts)
    return nodes, after, summary
