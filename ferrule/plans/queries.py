"""Registered queries: each takes ``(spark, sf_dir)`` and returns a lazy DataFrame.

Doubles are rounded to 6 places at the very end only so the oracle comparison
is insensitive to summation order; the operators themselves keep full precision.
The rounding is ``round(x * 1e6) / 1e6`` (half away from zero on the scaled
binary value), which is what the SQL side's ``round(x, 6)`` computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import metrics as M
from ferrule.sources import adapters as A

ROUND = 6


def rounded(df: DataFrame, places: int = ROUND) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            scale = float(10 ** places)
            cols.append((F.round(F.col(f.name) * scale) / scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def q_metrics_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly avg/min/max/count per event-type tag over the whole table."""
    return rounded(M.bucket_metrics(A.series_by_type(spark, sf_dir), "1 hour"))


QUERIES = {
    "metrics_hourly": q_metrics_hourly,
}


# --- time-bucket analytics ---------------------------------------------------

RANGE_START = "2024-01-10 00:00:00"
RANGE_END = "2024-01-20 12:00:00"


def q_metrics_range(spark, sf_dir):
    """Inclusive time-range predicate (pushed to the scan), 15-minute buckets."""
    return rounded(M.bucket_metrics(A.series_by_type(spark, sf_dir), "15 minutes", RANGE_START, RANGE_END))


def q_metrics_weekly(spark, sf_dir):
    """7-day buckets aligned to Monday 2000-01-03, per user tag."""
    return rounded(M.bucket_metrics(A.series_by_user(spark, sf_dir), "7 days"))


def q_metrics_trunc_day(spark, sf_dir):
    """A2: date_trunc variant, calendar days."""
    return rounded(M.trunc_metrics(A.series_by_type(spark, sf_dir), "day"))


def q_metrics_quarterly(spark, sf_dir):
    """T1 month-based: 3-month buckets from 2000-01 per supplier tag (lineitem series)."""
    return rounded(M.bucket_metrics(A.series_by_supplier(spark, sf_dir), "3 months"))


def q_metrics_signed(spark, sf_dir):
    """P8 option: signed numeric mode keeps negative readings."""
    return rounded(M.bucket_metrics(A.series_by_type(spark, sf_dir), "1 day", numeric_mode="signed"))


def q_gapfill_hourly(spark, sf_dir):
    """Gap-filled hourly metrics with first/last and locf(avg)."""
    return rounded(M.gapfilled_metrics(A.series_by_type(spark, sf_dir), "1 hour"))


def q_gapfill_users_range(spark, sf_dir):
    """A4 with explicit bounds: spine from bucket(start) to bucket(end) for every user tag."""
    return rounded(M.gapfilled_metrics(A.series_by_user(spark, sf_dir), "6 hours", RANGE_START, RANGE_END))


def q_first_last_daily(spark, sf_dir):
    """A5: first/last numeric reading by time per day."""
    return rounded(M.first_last(A.series_by_type(spark, sf_dir), "1 day"))


def q_daily_rollup(spark, sf_dir):
    """Per tag x day avg numeric + sample count."""
    return rounded(M.daily_rollup(A.series_by_user(spark, sf_dir)))


def q_upload_history(spark, sf_dir):
    """Per (tag name, frequency) count/first/last, newest first, top 20."""
    series = A.with_frequency(A.series_by_user(spark, sf_dir))
    return M.upload_history(series, A.user_tags(spark, sf_dir), plant_id=1, limit=20)


def q_tag_statistics(spark, sf_dir):
    """Per tag and day data points, first/last timestamp; the tag set is a
    DataFrame (every active tag), applied as a left-semi join."""
    tags = A.type_tags(spark, sf_dir)
    wanted = tags.filter("is_active").select("id")
    return M.tag_statistics(A.series_by_type(spark, sf_dir, tags), tags, wanted, RANGE_START, RANGE_END)


def q_latest_readings(spark, sf_dir):
    """time-range read, newest first, top 100."""
    return M.latest_readings(A.series_by_user(spark, sf_dir).drop("event_id"), RANGE_START, RANGE_END, 100)


# --- frequency -------------------------------------------------------------------

def q_frequency_by_user(spark, sf_dir):
    """A9/W2 per tag (user series)."""
    from ferrule.operators.frequency import frequency_by_key

    return frequency_by_key(A.series_by_user(spark, sf_dir), ["tag_id"])


def q_frequency_by_type(spark, sf_dir):
    """A9/W2 per tag (event-type series)."""
    from ferrule.operators.frequency import frequency_by_key

    return frequency_by_key(A.series_by_type(spark, sf_dir), ["tag_id"])


def q_frequency_of_file(spark, sf_dir):
    """A9 whole-file form: one ordering of every timestamp, two-level lag."""
    from ferrule.operators.frequency import frequency_of_frame
    from ferrule.sources.tables import read_table

    return frequency_of_frame(read_table(spark, sf_dir, "events", ["ts"]), "ts")


def q_median_gap_by_type(spark, sf_dir):
    """W2 + exact interpolated median gap per tag (reporting form)."""
    from ferrule.operators.frequency import median_gap_by_key

    return rounded(median_gap_by_key(A.series_by_type(spark, sf_dir), ["tag_id"]))


def q_gap_quantiles_by_user(spark, sf_dir):
    """Exact 10 %, 50 % and 90 % quantiles of the consecutive gaps per user tag."""
    from ferrule.operators.frequency import gap_quantiles_by_key

    return rounded(gap_quantiles_by_key(A.series_by_user(spark, sf_dir), ["tag_id"], {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


QUERIES.update({
    "metrics_range": q_metrics_range,
    "metrics_weekly": q_metrics_weekly,
    "metrics_trunc_day": q_metrics_trunc_day,
    "metrics_quarterly": q_metrics_quarterly,
    "metrics_signed": q_metrics_signed,
    "gapfill_hourly": q_gapfill_hourly,
    "gapfill_users_range": q_gapfill_users_range,
    "first_last_daily": q_first_last_daily,
    "daily_rollup": q_daily_rollup,
    "upload_history": q_upload_history,
    "tag_statistics": q_tag_statistics,
    "latest_readings": q_latest_readings,
    "frequency_by_user": q_frequency_by_user,
    "frequency_by_type": q_frequency_by_type,
    "frequency_of_file": q_frequency_of_file,
    "median_gap_by_type": q_median_gap_by_type,
    "gap_quantiles_by_user": q_gap_quantiles_by_user,
})


# --- wide-sheet ingest -------------------------------------------------------------

def _ingest(spark, sf_dir):
    from ferrule.plans.ingest import events_sheet, ingest_sheet

    tags = A.type_tags(spark, sf_dir)
    stored = A.with_frequency(A.series_by_type(spark, sf_dir, tags))
    return ingest_sheet(spark, events_sheet(spark, sf_dir), tags, stored)


def q_sheet_melt(spark, sf_dir):
    """Sheet CSV -> metadata -> lenient timestamps -> melt (non-missing cells)."""
    r = _ingest(spark, sf_dir)
    return r.melted.select("tag_name", "timestamp", "value")


def q_sheet_inserted(spark, sf_dir):
    """Mapped readings appended ignoring (tag_id, timestamp) conflicts."""
    r = _ingest(spark, sf_dir)
    return r.inserted.select("tag_id", "timestamp", "value", "frequency", "quality")


def q_sheet_tags(spark, sf_dir):
    """Tag get-or-create with metadata and default descriptions."""
    r = _ingest(spark, sf_dir)
    return (r.mapping.join(r.tags.select("name", "description", "unit_of_measure"), "name")
            .select("name", "id", "is_new", "description", "unit_of_measure"))


def q_sheet_counters(spark, sf_dir):
    """Upload quality counters."""
    return _ingest(spark, sf_dir).counters


def q_sheet_conflicts(spark, sf_dir):
    """A9 (file) + A10: tags whose stored frequency differs from the upload's."""
    return _ingest(spark, sf_dir).conflicts


def q_missing_tags(spark, sf_dir):
    """Uploaded tag names that have no stored tag."""
    from ferrule.operators.ingest import missing_tags
    from ferrule.plans.ingest import events_sheet
    from ferrule.sources.sheet import read_sheet

    sheet = read_sheet(spark, events_sheet(spark, sf_dir))
    names = spark.createDataFrame([(n,) for n in sheet.tag_columns], "name string")
    return missing_tags(names, A.type_tags(spark, sf_dir))


# --- keep-first merge -------------------------------------------------------------

MERGE_SPLIT = "2024-01-20 00:00:00"
MERGE_BATCH_FROM = "2024-01-15 00:00:00"


def _hourly_user_rows(spark, sf_dir):
    s = A.series_by_user(spark, sf_dir)
    return s.select("tag_id", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp"),
                    "value", F.col("event_id").alias("src_row"))


def q_keep_first(spark, sf_dir):
    """One row per (user tag, hour), the smallest event id wins."""
    from ferrule.operators.merge import keep_first

    return keep_first(_hourly_user_rows(spark, sf_dir)).select("tag_id", "timestamp", "value", "src_row")


def _merge_inputs(spark, sf_dir):
    from ferrule.operators.merge import keep_first

    rows = _hourly_user_rows(spark, sf_dir)
    target = keep_first(rows.filter(F.col("timestamp") < F.lit(MERGE_SPLIT).cast("timestamp_ntz")))
    batch = rows.filter(F.col("timestamp") >= F.lit(MERGE_BATCH_FROM).cast("timestamp_ntz"))
    return target, batch


def q_merge_append(spark, sf_dir):
    """M2: stored rows win, then the first batch row per key; snapshot after the merge."""
    from ferrule.operators.merge import merge_append

    target, batch = _merge_inputs(spark, sf_dir)
    _, snapshot = merge_append(target, batch)
    return snapshot.select("tag_id", "timestamp", "value", "src_row")


def q_duplicate_flags(spark, sf_dir):
    """Batch rows flagged when their key is already stored."""
    from ferrule.operators.merge import duplicate_flags

    target, batch = _merge_inputs(spark, sf_dir)
    return duplicate_flags(batch, target).select("tag_id", "timestamp", "src_row", "is_duplicate", "reason")


QUERIES.update({
    "sheet_melt": q_sheet_melt,
    "sheet_inserted": q_sheet_inserted,
    "sheet_tags": q_sheet_tags,
    "sheet_counters": q_sheet_counters,
    "sheet_conflicts": q_sheet_conflicts,
    "missing_tags": q_missing_tags,
    "keep_first": q_keep_first,
    "merge_append": q_merge_append,
    "duplicate_flags": q_duplicate_flags,
})


# --- hierarchy -------------------------------------------------------------------------

def _customer_nodes(spark, sf_dir):
    from ferrule.operators.hierarchy import parse_paths

    return parse_paths(A.customer_paths(spark, sf_dir), with_icon=True)


def q_hierarchy_nodes(spark, sf_dir):
    """Path list -> unique nodes in first-seen order with display names."""
    return _customer_nodes(spark, sf_dir).drop("is_active")


def q_hierarchy_summary(spark, sf_dir):
    """Path upload summary."""
    from ferrule.operators.hierarchy import path_summary

    return path_summary(A.customer_paths(spark, sf_dir))


def q_hierarchy_children(spark, sf_dir):
    """H8 bulk: (parent, child) rows of active nodes."""
    from ferrule.operators.hierarchy import children_all

    return children_all(_customer_nodes(spark, sf_dir))


def q_hierarchy_tree(spark, sf_dir):
    """Roots and parents with their direct children (flat)."""
    from ferrule.operators.hierarchy import tree

    return tree(_customer_nodes(spark, sf_dir))


def q_hierarchy_descendants(spark, sf_dir):
    """H9: every record reachable below each label, with depth."""
    from ferrule.operators.hierarchy import descendants

    nodes = _customer_nodes(spark, sf_dir)
    return descendants(nodes, nodes.filter("is_active").select("label").distinct())


def q_hierarchy_active(spark, sf_dir):
    """Active rows of a config table."""
    from ferrule.operators.hierarchy import active_nodes

    return active_nodes(A.supplier_config(spark, sf_dir)).select("label", "path", "parent_label", "display_order")


def q_hierarchy_integrity(spark, sf_dir):
    """H11 (J3 orphans + H12 cycles + A12 duplicate paths) on a config with defects."""
    from ferrule.operators.hierarchy import integrity_report

    issues, _ = integrity_report(A.supplier_config(spark, sf_dir))
    return issues


def q_hierarchy_integrity_summary(spark, sf_dir):
    """H11 summary row."""
    from ferrule.operators.hierarchy import integrity_report

    _, summary = integrity_report(A.supplier_config(spark, sf_dir))
    return summary.select("total_records", "orphaned", "circular", "duplicate_paths", "is_valid")


def q_display_names(spark, sf_dir):
    """H2/H3/H15 over every page URL and part name."""
    from ferrule.functions.text import clean_icon_name, default_icon, display_name
    from ferrule.sources.tables import read_table

    texts = (read_table(spark, sf_dir, "pages", ["url"]).select(F.col("url").alias("text"))
             .unionByName(read_table(spark, sf_dir, "part", ["p_name"]).select(F.col("p_name").alias("text"))))
    return texts.select("text", display_name("text").alias("display_name"),
                        default_icon("text").alias("icon"), clean_icon_name("text").alias("icon_name"))


QUERIES.update({
    "hierarchy_nodes": q_hierarchy_nodes,
    "hierarchy_summary": q_hierarchy_summary,
    "hierarchy_children": q_hierarchy_children,
    "hierarchy_tree": q_hierarchy_tree,
    "hierarchy_descendants": q_hierarchy_descendants,
    "hierarchy_active": q_hierarchy_active,
    "hierarchy_integrity": q_hierarchy_integrity,
    "hierarchy_integrity_summary": q_hierarchy_integrity_summary,
    "display_names": q_display_names,
})


# --- access --------------------------------------------------------------------------

def q_access_permissions(spark, sf_dir):
    """Distinct (user, plant, permission) over active access rows."""
    from ferrule.operators.access import effective_permissions

    t = A.access_tables(spark, sf_dir)
    return effective_permissions(t["upa"], t["role_permissions"], t["permissions"])


def q_access_any_plant(spark, sf_dir):
    """X1 any-plant form."""
    from ferrule.operators.access import effective_permissions

    t = A.access_tables(spark, sf_dir)
    return effective_permissions(t["upa"], t["role_permissions"], t["permissions"], per_plant=False)


def q_plant_access(spark, sf_dir):
    """(user, plant) pairs with both sides active."""
    from ferrule.operators.access import plant_access

    t = A.access_tables(spark, sf_dir)
    return plant_access(t["upa"], t["plants"])


def q_active_plants(spark, sf_dir):
    """Active plants by name."""
    from ferrule.operators.access import active_plants

    return active_plants(A.access_tables(spark, sf_dir)["plants"])


def q_accessible_workspaces(spark, sf_dir):
    """Workspaces each user may open, with owner/member role."""
    from ferrule.operators.access import accessible_workspaces

    t = A.access_tables(spark, sf_dir)
    return accessible_workspaces(t["users"], t["upa"], t["plants"], t["workspaces"], t["members"])


def _fallback(spark, sf_dir):
    from ferrule.operators.access import accessible_workspaces, workspace_access_with_fallback

    t = A.access_tables(spark, sf_dir)
    acc = accessible_workspaces(t["users"], t["upa"], t["plants"], t["workspaces"], t["members"])
    return workspace_access_with_fallback(t["ws_requests"], acc)


def q_workspace_fallback(spark, sf_dir):
    """Request verdicts with the number of alternative workspaces."""
    return _fallback(spark, sf_dir)[0]


def q_workspace_alternatives(spark, sf_dir):
    """For denied requests, each workspace the user may open in that plant."""
    return _fallback(spark, sf_dir)[1]


def q_card_access(spark, sf_dir):
    """Card access verdict per request with the granting rule."""
    from ferrule.operators.access import card_access, effective_permissions

    t = A.access_tables(spark, sf_dir)
    perms = effective_permissions(t["upa"], t["role_permissions"], t["permissions"], per_plant=False)
    return card_access(t["card_requests"], t["cards"], t["workspaces"], t["members"], perms)


QUERIES.update({
    "access_permissions": q_access_permissions,
    "access_any_plant": q_access_any_plant,
    "plant_access": q_plant_access,
    "active_plants": q_active_plants,
    "accessible_workspaces": q_accessible_workspaces,
    "workspace_fallback": q_workspace_fallback,
    "workspace_alternatives": q_workspace_alternatives,
    "card_access": q_card_access,
})


# --- storage layout, retention, table sources -----------------------------------------------

def _scratch_dir(spark, kind):
    import os
    import uuid

    from ferrule.session import ensure_checkpoint_dir

    return os.path.join(ensure_checkpoint_dir(spark), kind, uuid.uuid4().hex[:12])


def q_layout_range_read(spark, sf_dir):
    """Chunked layout write, then a range read with partition pruning."""
    from ferrule.sources.storage import read_series, write_series

    path = _scratch_dir(spark, "layout")
    write_series(A.series_by_type(spark, sf_dir), path, frequency="minute")
    return read_series(spark, path, RANGE_START, RANGE_END).select("tag_id", "timestamp", "value")


def q_layout_mixed_widths(spark, sf_dir):
    """One table from uploads of two chunk widths; a repeated upload in the other width
    inserts nothing, and a range read finds the rows of both."""
    from ferrule.sources.storage import merge_into_layout, read_series, write_series

    path = _scratch_dir(spark, "mixed-layout")
    series = A.series_by_type(spark, sf_dir).select("tag_id", "timestamp", "value")
    odd = F.col("tag_id") % 2 == 1
    write_series(series.filter(odd), path, interval="1 day", mode="overwrite")
    write_series(series.filter(~odd), path, interval="7 days")
    again = series.filter(F.col("timestamp") >= F.lit(RANGE_START).cast("timestamp_ntz"))
    merge_into_layout(spark, path, again.withColumn("src_row", F.monotonically_increasing_id()), "30 days")
    return read_series(spark, path, RANGE_START, RANGE_END).select("tag_id", "timestamp", "value")


RETENTION_AS_OF = "1998-12-01 00:00:00"


def _summarised_layout(spark, sf_dir, series):
    """The series in two uploads of different chunk widths, the second of which repeats a part of the first."""
    from ferrule.sources.storage import merge_into_layout, write_series

    path = _scratch_dir(spark, "layout")
    series = series.select("tag_id", "timestamp", "value", "frequency")
    odd = F.col("tag_id") % 2 == 1
    write_series(series.filter(odd), path, interval="7 days", mode="overwrite", with_summary=True)
    rest = series.filter(~odd | (F.col("tag_id") % 3 == 0))
    merge_into_layout(spark, path, rest.withColumn("src_row", F.monotonically_increasing_id()), "1 day")
    return path


def q_summary_upload_history(spark, sf_dir):
    """A7 from the chunk summaries of a layout of two uploads; no series file is read."""
    from ferrule.sources.summary import history_of_layout

    path = _summarised_layout(spark, sf_dir, A.with_frequency(A.series_by_user(spark, sf_dir)))
    return history_of_layout(spark, path, A.user_tags(spark, sf_dir), plant_id=1, limit=20)


def q_summary_counts(spark, sf_dir):
    """S9/A14 from the chunk summaries: rows and span per tag."""
    from ferrule.sources.summary import layout_counts

    path = _summarised_layout(spark, sf_dir, A.with_frequency(A.series_by_user(spark, sf_dir)))
    return layout_counts(spark, path).drop("chunks")


def q_summary_conflicts(spark, sf_dir):
    """A10 from the chunk summaries: the stored frequencies of every event type against an hourly upload of its whole span."""
    from ferrule.sources.summary import conflicts_of_layout, layout_counts

    tags = A.type_tags(spark, sf_dir)
    path = _summarised_layout(spark, sf_dir, A.with_frequency(A.series_by_type(spark, sf_dir, tags)))
    span = layout_counts(spark, path).agg(F.min("first"), F.max("last")).first()
    return conflicts_of_layout(spark, path, tags.select("name"), tuple(span), "hour", tags)


def q_latest_of_layout(spark, sf_dir):
    """F1 on a layout of two uploads: newest first in a time range, reading the newest chunks alone."""
    from ferrule.sources.summary import latest_of_layout

    path = _summarised_layout(spark, sf_dir, A.with_frequency(A.series_by_user(spark, sf_dir)))
    return latest_of_layout(spark, path, RANGE_START, RANGE_END, 100).select("tag_id", "timestamp", "value")


def q_retention_kept(spark, sf_dir):
    """Whole 30-day chunks older than as_of - 3 months are dropped; kept rows per tag."""
    from ferrule.operators.merge import retention

    kept, _ = retention(A.series_by_supplier(spark, sf_dir), RETENTION_AS_OF, "3 months", "30 days")
    return kept.groupBy("tag_id").agg(F.count(F.lit(1)).alias("kept_rows"), F.min("timestamp").alias("first_kept"))


def q_retention_dropped(spark, sf_dir):
    """The chunk starts that retention drops."""
    from ferrule.operators.merge import retention

    _, dropped = retention(A.series_by_supplier(spark, sf_dir), RETENTION_AS_OF, "3 months", "30 days")
    return dropped


def q_chunk_policy(spark, sf_dir):
    """Per tag frequency -> storage chunk width and rollup table name."""
    from ferrule.operators.frequency import chunk_interval, frequency_by_key, rollup_table

    f = frequency_by_key(A.series_by_user(spark, sf_dir), ["tag_id"])
    return f.select("tag_id", "frequency", chunk_interval(F.col("frequency")).alias("chunk_interval"),
                    rollup_table(F.col("frequency")).alias("rollup_table"))


def q_table_row_counts(spark, sf_dir):
    """Row count of every driver table."""
    from functools import reduce

    from ferrule.sources.tables import DRIVER_TABLES, read_table, row_count

    parts = [row_count(read_table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "row_count")
             for t in DRIVER_TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- streaming ---------------------------------------------------------------------------

def _stream_glob(sf_dir, name):
    import os

    return os.path.join(sf_dir, name + ".parquet*")


def _rollup_stream(spark, sf_dir, run):
    from ferrule.session import cut_lineage
    from ferrule.sources.tables import read_table

    # the static side of a stream-static join is materialised once (stable ids per batch)
    tags = cut_lineage(A.type_tags(spark, sf_dir).select(F.col("id").alias("tag_id"),
                                                         F.col("name").alias("event_type")))
    schema = read_table(spark, sf_dir, "events").schema

    def to_series(raw):
        return raw.join(tags, "event_type").select(
            "tag_id", F.col("ts").alias("timestamp"), A.reading_text(F.col("value"), F.col("props")).alias("value"))

    return rounded(run(spark, _stream_glob(sf_dir, "events"), schema, to_series))


def q_daily_rollup_stream(spark, sf_dir):
    """ST1: streaming daily rollup, 1-hour watermark, availableNow; open days are published and replaced as they grow."""
    from ferrule.streaming import run_live_rollup

    return _rollup_stream(spark, sf_dir, run_live_rollup)


def q_daily_rollup_closed(spark, sf_dir):
    """ST1: the days that the 1-hour watermark has closed (append mode)."""
    from ferrule.streaming import run_daily_rollup

    return _rollup_stream(spark, sf_dir, run_daily_rollup)


def q_keep_first_stream(spark, sf_dir):
    """ST2: exact keep-first on (tag_id, timestamp) over three uploads, each a micro-batch, stored in two chunk widths."""
    from ferrule.sources.tables import read_table
    from ferrule.streaming import run_keep_first_ingest

    events = read_table(spark, sf_dir, "events")
    src, target, checkpoint = (_scratch_dir(spark, k) for k in ("uploads", "ingest", "ingest-ckpt"))
    last = events.agg(F.max("event_id")).first()[0] or 0

    def to_rows(raw):
        return raw.select(F.col("user_id").cast("int").alias("tag_id"),
                          F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
                          A.reading_text(F.col("value"), F.col("props")).alias("value"),
                          F.col("event_id").alias("src_row"))

    for k, width in enumerate(("1 day", "7 days", "1 day")):
        upload = events.filter(F.floor(F.col("event_id") * 3 / F.lit(last + 1)) == k)
        upload.write.mode("append").parquet(src)
        out = run_keep_first_ingest(spark, src, events.schema, to_rows, target, checkpoint, chunk_interval=width)
    return out.select("tag_id", "timestamp", "value", "src_row")


QUERIES.update({
    "layout_range_read": q_layout_range_read,
    "layout_mixed_widths": q_layout_mixed_widths,
    "summary_upload_history": q_summary_upload_history,
    "summary_counts": q_summary_counts,
    "latest_of_layout": q_latest_of_layout,
    "summary_conflicts": q_summary_conflicts,
    "retention_kept": q_retention_kept,
    "retention_dropped": q_retention_dropped,
    "chunk_policy": q_chunk_policy,
    "table_row_counts": q_table_row_counts,
    "daily_rollup_stream": q_daily_rollup_stream,
    "daily_rollup_closed": q_daily_rollup_closed,
    "keep_first_stream": q_keep_first_stream,
})


# --- icons -------------------------------------------------------------------------------

def _page_files(spark, sf_dir):
    """Every page body as an icon candidate file ``page_<id>.svg``."""
    from ferrule.sources.tables import read_table

    pages = read_table(spark, sf_dir, "pages", ["page_id", "html"])
    return pages.select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".svg")).alias("file_name"),
                        F.encode(F.col("html"), "UTF-8").alias("content"), "page_id")


def q_icon_audit(spark, sf_dir):
    """V1: SVG audit over every page body (XML parse in an Arrow-batched pandas UDF)."""
    from ferrule.operators.icons import audit_svg

    return audit_svg(_page_files(spark, sf_dir)).select("file_name", "is_valid", "error", "file_size")


def _icon_files(spark, sf_dir):
    """One icon file per page; its kind, and so its defect, follows from the page id."""
    from ferrule.sources.tables import read_table

    page = F.col("page_id").cast("string")
    kinds = {
        1: "<svg><text>page #</text></svg>",
        2: "<svg><!--" + " " * 64 + "--><text>page #</text></svg>",
        3: "<svg><text>page #</svg>",
        4: "<div>page #</div>",
        5: "<svg><SCRIPT>page #</SCRIPT></svg>",
        6: '<svg onload="go()"><rect id="r#" onClick="stop()"/>page #</svg>',
        7: '<svg xmlns:x="urn:x"><x:script>bad <b>#</b></x:script>page #</svg>',
        8: "<svg><a href=\"#\">1 &lt; 2</a><iframe2/></svg>",
    }
    kind = F.col("page_id") % 9
    text = F.lit('<svg xmlns="http://www.w3.org/2000/svg"><text>page #</text></svg>')
    for k, body in kinds.items():
        text = F.when(kind == k, F.lit(body)).otherwise(text)
    text = F.replace(text, F.lit("#"), page)
    text = F.when(F.col("page_id") % 90 == 2, F.concat(text, F.lit(" " * 1024), F.repeat(F.lit(" " * 1024), 1024))).otherwise(text)
    name = F.concat(F.lit("icon_"), page, F.when(kind == 1, ".png").when(kind == 8, ".SVG").otherwise(".svg"))
    return read_table(spark, sf_dir, "pages", ["page_id"]).select(name.alias("file_name"), F.encode(text, "UTF-8").alias("content"))


def q_icon_audit_files(spark, sf_dir):
    """V1 over icon files of every kind of defect."""
    from ferrule.operators.icons import audit_svg

    return audit_svg(_icon_files(spark, sf_dir)).select("file_name", "is_valid", "error", "file_size")


def q_icon_clean(spark, sf_dir):
    """V2: cleaned text of the valid icon files."""
    from ferrule.operators.icons import audit_svg, clean_svg

    return clean_svg(audit_svg(_icon_files(spark, sf_dir))).filter("is_valid").select("file_name", "clean_svg")


def q_icon_inventory(spark, sf_dir):
    """Icon name (suffix rule), size and base64 content per file."""
    from ferrule.operators.icons import icon_inventory

    return icon_inventory(_page_files(spark, sf_dir))


QUERIES.update({
    "icon_audit": q_icon_audit,
    "icon_audit_files": q_icon_audit_files,
    "icon_clean": q_icon_clean,
    "icon_inventory": q_icon_inventory,
})


# --- remaining maintenance / validation operators -------------------------------------------

def q_range_check(spark, sf_dir):
    """readings outside their tag's limits (limits joined by tag name)."""
    from ferrule.operators.merge import range_check

    tags = A.type_tags(spark, sf_dir)
    out = range_check(A.series_by_type(spark, sf_dir, tags), tags, A.type_limits(spark))
    return out.filter("is_abnormal").select("tag_name", "timestamp", "value", "reason")


def q_timestamp_normalize(spark, sf_dir):
    """P5/T5: text timestamps in several layouts -> first matching format -> canonical text."""
    from ferrule.functions.timebucket import normalize_timestamp_text

    t = A.timestamp_texts(spark, sf_dir)
    return t.select("event_id", "text", normalize_timestamp_text("text").alias("normalized"))


def q_default_sources(spark, sf_dir):
    """Oldest active source per plant, or a new default source id."""
    from ferrule.operators.ingest import default_sources

    plants = A.access_tables(spark, sf_dir)["plants"]
    return default_sources(plants, A.supplier_sources(spark, sf_dir), "2024-01-01 00:00:00")


def q_hierarchy_update(spark, sf_dir):
    """M4: bulk allow-listed update by label: two change rows per nation (the later one gives the
    display name only), and a third that sets one nation's icon to NULL."""
    from ferrule.operators.merge import apply_updates
    from ferrule.sources.tables import read_table

    nodes = _customer_nodes(spark, sf_dir)
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    change = F.explode(F.array(
        F.struct(F.lit(1).alias("nr"), F.lit("old name").alias("display_name"), F.lit("flag").alias("icon"),
                 F.array(F.lit("display_name"), F.lit("icon"), F.lit("display_order")).alias("fields")),
        F.struct(F.lit(2).alias("nr"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("display_name"),
                 F.lit("unused").alias("icon"), F.array(F.lit("display_name")).alias("fields")),
        F.struct(F.lit(3).alias("nr"), F.lit("unused").alias("display_name"), F.lit(None).cast("string").alias("icon"),
                 F.when(F.col("n_nationkey") == 0, F.array(F.lit("icon"))).otherwise(F.array().cast("array<string>")).alias("fields"))))
    changes = nation.select(F.col("n_name").alias("label"), change.alias("c")).select(
        "label", "c.*", F.lit(-1).alias("display_order"))
    return apply_updates(nodes, changes, ["label"], ["display_name", "icon", "path", "parent_label", "is_active"],
                         order="nr", given="fields") \
        .select("label", "path", "parent_label", "display_order", "display_name", "icon")


def q_hierarchy_delete_cascade(spark, sf_dir):
    """M6 with cascade: deleting every nation label removes the nations and, through the
    label links, every segment below them; the regions remain."""
    from ferrule.operators.hierarchy import delete_by_label
    from ferrule.sources.tables import read_table

    nodes = _customer_nodes(spark, sf_dir)
    nations = read_table(spark, sf_dir, "nation", ["n_name"]).select(F.col("n_name").alias("label"))
    remaining, _ = delete_by_label(nodes, nations, cascade=True)
    return remaining.select("label", "path", "parent_label")


def q_hierarchy_replace(spark, sf_dir):
    """Validate-then-replace one plant's hierarchy in a table of several plants and rows of none."""
    from ferrule.operators.hierarchy import replace_hierarchy

    third = F.length("path") % 3
    existing = A.supplier_config(spark, sf_dir).withColumn("plant_id", F.when(third > 0, third))
    after, _ = replace_hierarchy(existing, _customer_nodes(spark, sf_dir), plant_id=1)
    return after.select("plant_id", "label", "path")


def q_rekey_collisions(spark, sf_dir):
    """Enforce (tag_id, timestamp) after dropping a column; colliding keys reported."""
    from ferrule.operators.merge import rekey

    s = A.series_by_supplier(spark, sf_dir).withColumn("src_row", F.monotonically_increasing_id())
    _, collisions = rekey(s, ["quality"])
    return collisions


def q_unknown_tags(spark, sf_dir):
    """Melted sheet cells whose tag name has no stored tag, counted per name."""
    from ferrule.operators.ingest import map_tags, melt, sheet_rows
    from ferrule.plans.ingest import events_sheet
    from ferrule.sources.sheet import read_sheet

    sheet = read_sheet(spark, events_sheet(spark, sf_dir))
    long = melt(sheet_rows(sheet), list(sheet.tag_columns))
    _, unknown = map_tags(long, A.type_tags(spark, sf_dir))
    return unknown


def q_workspace_roles(spark, sf_dir):
    """Owner / member flags per (user, active workspace)."""
    from ferrule.operators.access import workspace_roles

    t = A.access_tables(spark, sf_dir)
    return workspace_roles(t["workspaces"], t["members"])


QUERIES.update({
    "range_check": q_range_check,
    "timestamp_normalize": q_timestamp_normalize,
    "default_sources": q_default_sources,
    "hierarchy_update": q_hierarchy_update,
    "hierarchy_delete_cascade": q_hierarchy_delete_cascade,
    "hierarchy_replace": q_hierarchy_replace,
    "rekey_collisions": q_rekey_collisions,
    "unknown_tags": q_unknown_tags,
    "workspace_roles": q_workspace_roles,
})


REFRESH_AS_OF = "2024-01-20 12:00:00"


def q_daily_rollup_refresh(spark, sf_dir):
    """A6 materialised: refresh the whole days in [as_of - 1 month, as_of - 1 hour] with dynamic
    partition overwrite, then read the rollup table back."""
    from ferrule.operators.metrics import refresh_daily_rollup

    path = _scratch_dir(spark, "rollup")
    refresh_daily_rollup(A.series_by_user(spark, sf_dir), path, REFRESH_AS_OF)
    return rounded(spark.read.parquet(path).select("tag_id", "bucket", "avg_value", "sample_count"))


QUERIES["daily_rollup_refresh"] = q_daily_rollup_refresh


def _sheet_number(file):
    return F.regexp_extract(file, "block=([0-9]+)", 1).cast("int")


def _ingest_folder(spark, sf_dir, create_tags=True):
    """The user sheets against stored tags of three users in four and the stored readings of the days before."""
    from ferrule.plans.ingest import ingest_sheets, user_sheets

    users = A.user_tags(spark, sf_dir).select(F.col("id"), F.concat(F.lit("user_"), F.col("id").cast("string")).alias("name"))
    tags = users.filter(F.col("id") % 4 != 0).select(
        "id", "name", F.lit("kept").alias("description"), F.lit(None).cast("string").alias("unit_of_measure"), F.lit(1).alias("plant_id"),
        F.lit(True).alias("is_active"), F.lit(1).alias("data_source_id"))
    stored = (A.series_by_user(spark, sf_dir).filter((F.dayofmonth("timestamp") <= 3) & (F.col("tag_id") % 4 != 0))
              .select("tag_id", F.date_trunc("second", "timestamp").cast("timestamp_ntz").alias("timestamp"), "value",
                      F.lit("hour").alias("frequency"), "quality"))
    return ingest_sheets(spark, user_sheets(spark, sf_dir), tags, stored, create_tags=create_tags)


def q_sheet_folder_melt(spark, sf_dir):
    """S1-S3/P1-P4 over a folder: every cell of every sheet, whatever its header and its order of day and month."""
    out = _ingest_folder(spark, sf_dir).melted
    return out.select(_sheet_number("file").alias("sheet"), "tag_name", "timestamp", "value")


def q_sheet_folder_inserted(spark, sf_dir):
    """J4/M2/W3 over a folder: readings appended ignoring (tag, timestamp) conflicts, with each file's frequency."""
    r = _ingest_folder(spark, sf_dir)
    names = r.mapping.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"))
    return r.inserted.join(names, "tag_id").select("tag_name", "timestamp", "value", "frequency", "quality")


def q_sheet_folder_counters(spark, sf_dir):
    """P7/U1 over a folder that may not make tags: cells of unmapped tags are counted."""
    out = _ingest_folder(spark, sf_dir, create_tags=False).counters
    return out.withColumn("sheet", _sheet_number("file")).drop("file")


def q_sheet_folder_tags(spark, sf_dir):
    """M1/P6/S2 over a folder: tags made with their descriptions (line breaks kept) and units, known ones left alone."""
    r = _ingest_folder(spark, sf_dir)
    return r.tags.select("name", "description", "unit_of_measure")


QUERIES.update({"sheet_folder_melt": q_sheet_folder_melt, "sheet_folder_inserted": q_sheet_folder_inserted,
                "sheet_folder_counters": q_sheet_folder_counters, "sheet_folder_tags": q_sheet_folder_tags})


def q_rollup_cascade(spark, sf_dir):
    """Minute, hour, day, week, month and year tables, each merged from a finer one; the series is read once."""
    from ferrule.operators import rollup

    tables = [t for t in rollup.TABLE_BUCKETS if t != "time_bucket_second"]
    path = _scratch_dir(spark, "cascade")
    rollup.build_cascade(A.series_by_type(spark, sf_dir), path, tables)
    out = None
    for table in tables:
        one = rollup.read_rollup(spark, path, table).select(F.lit(table).alias("rollup"), "*")
        out = one if out is None else out.union(one)
    return rounded(out)


def q_rollup_of_frequency(spark, sf_dir):
    """The rollup that serves the detected frequency of the whole event series, from the cascade."""
    from ferrule.operators import rollup
    from ferrule.operators.frequency import frequency_of_frame
    from ferrule.sources.tables import read_table

    path = _scratch_dir(spark, "cascade")
    rollup.build_cascade(A.series_by_type(spark, sf_dir), path)
    label = frequency_of_frame(read_table(spark, sf_dir, "events", ["ts"]), "ts").first()["frequency"]
    return rounded(rollup.rollup_for(spark, path, label).withColumn("frequency", F.lit(label).cast("string")))


def q_rollup_follows_changes(spark, sf_dir):
    """A daily rollup refreshed from the ledger of touched days after a first load, deletes and late rows.

    The second refresh has a later window: it also takes the days the first one had to leave in the ledger."""
    from ferrule.operators.rollup import read_daily, record_touched, refresh_touched
    from ferrule.sources.storage import delete_from_layout, merge_into_layout, read_series, write_series

    path, rollup = _scratch_dir(spark, "layout"), _scratch_dir(spark, "rollup")
    series = A.series_by_user(spark, sf_dir).select("tag_id", "timestamp", "value")
    late = F.col("tag_id") % 5 == 0
    write_series(series.filter(~late), path, interval="1 day", mode="overwrite")
    stored = lambda: read_series(spark, path).select("tag_id", "timestamp", "value")
    record_touched(stored(), rollup)
    refresh_touched(stored(), rollup, REFRESH_AS_OF)
    day = F.dayofmonth("timestamp")
    gone = stored().filter(((F.col("tag_id") % 3 == 0) & day.between(5, 8)) | (day == 10) | ((day == 25) & (F.col("tag_id") % 2 == 0)))
    delete_from_layout(spark, path, gone, rollup)
    merge_into_layout(spark, path, series.filter(late).withColumn("src_row", F.monotonically_increasing_id()), "7 days", rollup=rollup)
    refresh_touched(stored(), rollup, "2024-01-31 12:00:00")
    return rounded(read_daily(spark, rollup).select("tag_id", "bucket", "avg_value", "sample_count"))


QUERIES.update({"rollup_cascade": q_rollup_cascade, "rollup_of_frequency": q_rollup_of_frequency,
                "rollup_follows_changes": q_rollup_follows_changes})


def q_merge_append_zone(spark, sf_dir):
    """M2 in a session whose zone is not UTC: the same wall-clock keys collide."""
    from ferrule.session import cut_lineage

    zone = spark.conf.get("spark.sql.session.timeZone")
    target, batch = (cut_lineage(x) for x in _merge_inputs(spark, sf_dir))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        from ferrule.operators.merge import merge_append

        return cut_lineage(merge_append(target, batch)[1].select("tag_id", "timestamp", "value", "src_row"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def q_metrics_small_values(spark, sf_dir):
    """A1 on readings of 14 decimals: averages keep the digits (scaled by 1e9 in the result)."""
    from ferrule.functions.numeric import exact_avg, numeric_value
    from ferrule.sources.tables import read_table

    text = F.concat(F.lit("0.0000000000"), F.lpad((F.col("event_id") % 9973).cast("string"), 4, "0"))
    rows = read_table(spark, sf_dir, "events", ["event_id", "event_type"]).withColumn("value", text)
    return rows.groupBy("event_type").agg(
        F.round(exact_avg("value") * 1e9, 6).alias("avg_value"),
        F.round(F.max(numeric_value("value")) * 1e9, 6).alias("max_value"))


QUERIES.update({"merge_append_zone": q_merge_append_zone, "metrics_small_values": q_metrics_small_values})


def q_hierarchy_upload(spark, sf_dir):
    """E3 flow (A15 + H1 + H13): upload summary of a path list replacing a plant hierarchy."""
    from ferrule.plans.hierarchy import upload_hierarchy

    existing = A.supplier_config(spark, sf_dir).withColumn("plant_id", F.lit(1))
    _, _, summary = upload_hierarchy(A.customer_paths(spark, sf_dir), existing, plant_id=1)
    return summary


QUERIES["hierarchy_upload"] = q_hierarchy_upload


def q_layout_merge(spark, sf_dir):
    """M2 + S12: keep-first append into the chunked layout, the lookup of stored keys
    pruned to the chunks the batch spans; the stored table afterwards."""
    from ferrule.sources.storage import merge_into_layout, write_series

    target, batch = _merge_inputs(spark, sf_dir)
    path = _scratch_dir(spark, "merge-layout")
    write_series(target.select("tag_id", "timestamp", "value"), path, interval="7 days", mode="overwrite")
    merge_into_layout(spark, path, batch.select("tag_id", "timestamp", "value", "src_row"), "7 days")
    return spark.read.parquet(path).select("tag_id", "timestamp", "value")


QUERIES["layout_merge"] = q_layout_merge


# --- record readers (S4-S6): a driver table written as CSV / JSON / XML and read back -----

def _records(spark, sf_dir, fmt):
    from ferrule.sources import sheet as S
    from ferrule.sources.tables import read_table

    cust = read_table(spark, sf_dir, "customer")
    path = _scratch_dir(spark, f"records-{fmt}")
    if fmt == "csv":
        cust.write.option("header", True).csv(path)
        return S.read_csv_records(spark, path, schema=cust.schema)
    if fmt == "json":
        cust.write.json(path)
        return S.read_json_records(spark, path, schema=cust.schema, multi_line=False)
    cust.write.format("xml").option("rootTag", "root").option("rowTag", "record").save(path)
    return S.read_xml_records(spark, path, schema=cust.schema)


def q_records_csv(spark, sf_dir):
    """CSV records with a header line."""
    return _records(spark, sf_dir, "csv")


def q_records_json(spark, sf_dir):
    """JSON records."""
    return _records(spark, sf_dir, "json")


def q_records_xml(spark, sf_dir):
    """XML records under root/record."""
    return _records(spark, sf_dir, "xml")


QUERIES.update({"records_csv": q_records_csv, "records_json": q_records_json, "records_xml": q_records_xml})


def q_split_files(spark, sf_dir):
    """A whole table written as CSV files of at most 500,000 rows, read back."""
    from ferrule.sources.storage import SPLIT_ROWS, split_csv
    from ferrule.sources.tables import read_table

    li = read_table(spark, sf_dir, "lineitem")
    path = _scratch_dir(spark, "split")
    split_csv(li, path)
    back = spark.read.option("header", True).schema(li.schema).csv(path).withColumn("_f", F.input_file_name())
    per_file = back.groupBy("_f").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").cast("bigint").alias("total_rows"),
                        (F.max("n") <= SPLIT_ROWS).alias("within_limit"))


COMPACT_BEFORE = "1996-01-01 00:00:00"


def q_compaction(spark, sf_dir):
    """R2: chunks that end before a date rewritten in the sorted layout and swapped in; the
    whole table afterwards."""
    from ferrule.sources.storage import compact_chunks, write_series

    path = _scratch_dir(spark, "compact")
    write_series(A.series_by_supplier(spark, sf_dir), path, interval="30 days", mode="overwrite")
    compact_chunks(spark, path, COMPACT_BEFORE)
    return spark.read.parquet(path).select("tag_id", "timestamp", "value")


QUERIES.update({"split_files": q_split_files, "compaction": q_compaction})


def q_legacy_permissions(spark, sf_dir):
    """Permissions through the single role of each user."""
    from ferrule.operators.access import legacy_permissions

    t = A.access_tables(spark, sf_dir)
    return legacy_permissions(t["legacy_users"], t["role_permissions"], t["permissions"])


def q_user_roles(spark, sf_dir):
    """Role of each user."""
    from ferrule.operators.access import user_roles

    t = A.access_tables(spark, sf_dir)
    return user_roles(t["legacy_users"], t["roles"])


QUERIES.update({"legacy_permissions": q_legacy_permissions, "user_roles": q_user_roles})


def q_permission_checks(spark, sf_dir):
    """X1 membership test: may each ordering customer view any user's cards in each
    plant it buys from?"""
    from ferrule.operators.access import effective_permissions, permission_checks

    t = A.access_tables(spark, sf_dir)
    perms = effective_permissions(t["upa"], t["role_permissions"], t["permissions"])
    req = t["upa"].select("user_id", "plant_id").distinct().withColumn("permission", F.lit("view_any_user_cards"))
    return permission_checks(req, perms, t["users"])


QUERIES["permission_checks"] = q_permission_checks


# --- lookups, deletes, imports and reports that were only unit-tested --------------------

def q_hierarchy_all_nodes(spark, sf_dir):
    """H5: every node, inactive included."""
    from ferrule.operators.hierarchy import all_nodes

    return all_nodes(A.supplier_config(spark, sf_dir)).select("label", "path", "parent_label", "display_order", "is_active")


def q_hierarchy_lookup(spark, sf_dir):
    """H6 / H7: the nodes of one label, and those of a label under one path."""
    from ferrule.operators.hierarchy import nodes_by_label

    nodes = _customer_nodes(spark, sf_dir)
    by_label = nodes_by_label(nodes, "BUILDING").withColumn("lookup", F.lit("label"))
    by_path = nodes_by_label(nodes, "BUILDING", "AFRICA:KENYA:BUILDING").withColumn("lookup", F.lit("path"))
    return by_label.unionByName(by_path).select("lookup", "label", "path", "parent_label")


def q_hierarchy_icons(spark, sf_dir):
    """Icon names of the nodes resolved to files of an inventory."""
    from ferrule.operators.hierarchy import resolve_icons
    from ferrule.sources.tables import read_table

    nodes = _customer_nodes(spark, sf_dir).select("label", "path", F.lower("label").alias("icon"))
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    stem = F.concat(F.lower("n_name"), F.lit("_"), F.col("n_nationkey").cast("string"), F.lit(".svg"))
    files = nation.select(stem.alias("file_name"), F.concat(F.lit("/icons/"), stem).alias("file_path"))
    return resolve_icons(nodes, files)


def q_source_delete_all(spark, sf_dir):
    """M7: one plant's rows cleared; other plants' rows and those of none stay."""
    from ferrule.operators.merge import delete_all

    third = F.length("path") % 3
    cfg = A.supplier_config(spark, sf_dir).withColumn("plant_id", F.when(third > 0, third))
    return delete_all(cfg, 1).select("plant_id", "label", "path")


def q_update_by_id(spark, sf_dir):
    """M5: rows updated by id; fields outside the allow list stay."""
    from ferrule.operators.merge import apply_updates
    from ferrule.sources.tables import read_table

    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"])
    changes = part.filter(F.col("p_partkey") % 3 == 0).select(
        "p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("p_name"), F.lit(-1).alias("p_size"))
    return apply_updates(part, changes, ["p_partkey"], ["p_name"])


def q_table_columns(spark, sf_dir):
    """Column names of a table, by position, with the table's row count beside them."""
    from ferrule.sources.storage import list_columns
    from ferrule.sources.tables import read_table, row_count

    nation = read_table(spark, sf_dir, "customer")
    return list_columns(nation).select("column_name").join(row_count(nation).hint("broadcast"), F.lit(True))


def q_import_tables(spark, sf_dir):
    """Whitelisted import between tables: stored keys win, then the first source row; a table that is
    not on the list is not copied."""
    from ferrule.sources.storage import import_tables

    target, batch = _merge_inputs(spark, sf_dir)
    out = import_tables({"time_series": batch, "alerts": batch}, {"time_series": target.drop("src_row")})
    (name, (_, snapshot)), = out.items()
    return snapshot.select(F.lit(name).alias("table_name"), "tag_id", "timestamp", "value")


def q_import_changed(spark, sf_dir):
    """S8 repeated: a first import, then one of the grown source that copies only the key ranges that differ."""
    from ferrule.sources.imports import import_changed

    path = _scratch_dir(spark, "import")
    target, batch = (x.select("tag_id", "timestamp", "value", "src_row") for x in _merge_inputs(spark, sf_dir))
    import_changed(target, path, ["tag_id", "timestamp"], "src_row", ranges=32)
    import_changed(target.union(batch), path, ["tag_id", "timestamp"], "src_row", ranges=32)
    return spark.read.parquet(path).select(F.lit("time_series").alias("table_name"), "tag_id", "timestamp", "value")


QUERIES["import_changed"] = q_import_changed


def q_records_json_array(spark, sf_dir):
    """S6 in its upload form: JSON arrays, of at most 1,000 records a file."""
    from ferrule.sources import sheet as S
    from ferrule.sources.tables import read_table

    cust = read_table(spark, sf_dir, "customer")
    path = _scratch_dir(spark, "records-json-array")
    record = F.to_json(F.struct(*cust.columns))
    parts = cust.groupBy((F.floor(F.col("c_custkey") / 1000)).alias("file")).agg(F.concat_ws(",", F.collect_list(record)).alias("body"))
    (parts.select("file", F.concat(F.lit("["), F.col("body"), F.lit("]")).alias("value"))
     .write.partitionBy("file").text(path))  # one array per file
    return S.read_json_records(spark, path + "/file=*", schema=cust.schema, multi_line=True)


def q_iso_range_output(spark, sf_dir):
    """ISO-8601 bounds with zone suffixes; result timestamps rendered as ISO text."""
    from ferrule.functions.timebucket import iso_bound, iso_format

    rows = M.time_range(A.series_by_type(spark, sf_dir), iso_bound("2024-01-10T00:00:00Z"), iso_bound("2024-01-20T12:00:00+02:00"))
    return rows.select("tag_id", iso_format("timestamp").alias("timestamp"), "value")


def q_tag_statistics_gapfilled(spark, sf_dir):
    """A8 with every day of the requested bounds."""
    tags = A.type_tags(spark, sf_dir)
    out = M.tag_statistics(A.series_by_type(spark, sf_dir, tags), tags, None, "2023-12-25 06:00:00", RANGE_END, gapfill=True)
    return out.select("tag_id", "name", "day", "data_points", "first_timestamp", "last_timestamp")


def q_tag_statistics_keep_empty(spark, sf_dir):
    """Tags without a row in the range stay, with a NULL day."""
    tags = A.type_tags(spark, sf_dir)
    out = M.tag_statistics(A.series_by_type(spark, sf_dir, tags).filter(F.col("tag_id") % 2 == 1), tags, None, RANGE_START,
                           RANGE_END, keep_empty=True)
    return out.select("tag_id", "name", "day", "data_points")


def q_card_access_admin(spark, sf_dir):
    """X5 with an admin role: its holders pass first."""
    from ferrule.operators.access import card_access, effective_permissions
    from ferrule.session import cut_lineage

    t = A.access_tables(spark, sf_dir)
    perms = effective_permissions(t["upa"], t["role_permissions"], t["permissions"], per_plant=False)
    requests = cut_lineage(t["card_requests"])
    admins = requests.select("user_id").distinct().filter(F.col("user_id") % 10 == 0)
    return card_access(requests, t["cards"], t["workspaces"], t["members"], perms, admins)


QUERIES.update({
    "hierarchy_all_nodes": q_hierarchy_all_nodes, "hierarchy_lookup": q_hierarchy_lookup, "hierarchy_icons": q_hierarchy_icons,
    "plant_delete_all": q_source_delete_all, "update_by_id": q_update_by_id, "table_columns": q_table_columns,
    "import_tables": q_import_tables, "records_json_array": q_records_json_array, "iso_range_output": q_iso_range_output,
    "tag_statistics_gapfilled": q_tag_statistics_gapfilled, "tag_statistics_keep_empty": q_tag_statistics_keep_empty,
    "card_access_admin": q_card_access_admin,
})
