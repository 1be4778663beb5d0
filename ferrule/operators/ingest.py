"""Sheet ingest operators: clean, melt, count, tag upsert, tag mapping.

The melt is a per-row ``explode`` of a fixed-size array of ``(tag, cell)``
structs -- narrow, no shuffle; the first shuffle of the ingest is the
keep-first merge on ``(tag_id, timestamp)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.timebucket import DAY_FIRST_FORMATS, ISO_FORMATS, MONTH_FIRST_FORMATS, parse_timestamp_text
from ferrule.session import cut_lineage
from ferrule.sources.sheet import Sheet, SheetError, na_to_null

# Default description of a tag created by an upload.
DEFAULT_DESCRIPTION = "Sensor data collected at %s intervals"


def sheet_rows(sheet: Sheet, check_all_bad: bool = True) -> DataFrame:
    """Typed sheet rows: ``_line, timestamp, cells`` (one text per distinct tag name, in their order).

    Duplicate header names keep the first non-missing cell (P2); missing-value
    tokens become NULL (P3); timestamps parse leniently and unparseable rows drop (P4).
    The cells are one array, so expressions stay flat however many tags a sheet has.
    """
    parsed = parse_timestamp_text(F.col("ts_text"), sheet_formats(sheet.data)).alias("timestamp")
    raw = [F.col(c[0]) if len(c) == 1 else F.coalesce(*[na_to_null(F.col(x)) for x in c])
           for c in sheet.tag_columns.values()]
    array = F.array(*raw) if raw else F.array().cast("array<string>")
    rows = sheet.data.select("_line", parsed, F.transform(array, na_to_null).alias("cells")).filter(
        F.col("timestamp").isNotNull())
    # stops at the first parseable line; only an all-bad sheet is read to the end
    if check_all_bad and rows.isEmpty():  # Fixed value: the message
        raise SheetError(f"All values in {sheet.time_column} could not be converted to datetime.")
    return rows


def sheet_formats(data: DataFrame, ts: str = "ts_text") -> tuple:
    """Timestamp layouts of a sheet: one order of day and month per file.  Month first, unless
    some value reads only with the day first and none only with the month first (one aggregate job
    over the timestamp column)."""
    month = parse_timestamp_text(F.col(ts), MONTH_FIRST_FORMATS).isNotNull()
    day = parse_timestamp_text(F.col(ts), DAY_FIRST_FORMATS).isNotNull()
    row = data.agg(F.bool_or(month & ~day).alias("month_only"), F.bool_or(day & ~month).alias("day_only")).first()
    day_first = bool(row["day_only"]) and not row["month_only"]
    return ISO_FORMATS + (DAY_FIRST_FORMATS if day_first else MONTH_FIRST_FORMATS)


def folder_rows(sheets) -> DataFrame:
    """Typed lines of a folder of sheets: ``file, _line, timestamp, names, cells``; the order of day and month
    is one per file (``sheet_formats``), NULL where a text does not parse."""
    month = parse_timestamp_text(F.col("ts_text"), MONTH_FIRST_FORMATS)
    day = parse_timestamp_text(F.col("ts_text"), DAY_FIRST_FORMATS)
    order = cut_lineage(sheets.data.groupBy("file").agg(  # a row per file, of measured size: lines are not shuffled
        F.bool_or(month.isNotNull() & day.isNull()).alias("_month_only"), F.bool_or(day.isNotNull() & month.isNull()).alias("_day_only")))
    iso = parse_timestamp_text(F.col("ts_text"), ISO_FORMATS)
    turned = F.when(F.col("_day_only") & ~F.col("_month_only"), day).otherwise(month)
    return sheets.data.join(order, "file").select("file", "_line", F.coalesce(iso, turned).alias("timestamp"), "names", "cells")


def folder_counters(rows: DataFrame, cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """The counters of ``ingest_counters`` per file: ``rows`` are its typed lines, ``cells`` one row per line and tag."""
    known = mapping.select(F.col("name").alias("tag_name"), F.lit(True).alias("_known"))
    value, is_known = F.col("value"), F.coalesce("_known", F.lit(False))
    count = lambda met, name: F.count_if(met).cast("bigint").alias(name)
    out = cells.join(known, "tag_name", "left").groupBy("file").agg(
        count(is_known, "total_values"), count(is_known & (F.coalesce(value.try_cast("double"), F.lit(1.0)) == 0), "zero_values"),
        count(is_known & value.isNull(), "nan_values"), count(~is_known, "missing_tag_values"),
        count(is_known & value.isNotNull(), "prepared_records"), F.count(F.lit(1)).alias("expected_records"))
    lines = rows.groupBy("file").agg(F.count(F.lit(1)).alias("row_count"))
    return lines.join(out, "file", "left").select(
        "file", "row_count", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
                               ("total_values", "zero_values", "nan_values", "missing_tag_values", "prepared_records", "expected_records")])


def known_tags(existing: DataFrame, upload_names: DataFrame) -> DataFrame:
    """Mapping ``name, id, is_new`` of the uploaded names that have a stored tag; none is made."""
    return (existing.select("name", "id").join(upload_names.select("name").distinct(), "name", "left_semi")
            .withColumn("is_new", F.lit(False)))


def melt(rows: DataFrame, tag_names) -> DataFrame:
    """Wide -> long: ``_line, timestamp, tag_name, value`` for every non-missing cell.

    Zero readings are kept; the raw text is kept as stored value."""
    names = F.array(*[F.lit(n) for n in tag_names]) if tag_names else F.array().cast("array<string>")
    long = rows.select("_line", "timestamp", F.posexplode("cells").alias("_nr", "value"))
    return (long.filter(F.col("value").isNotNull())
            .select("_line", "timestamp", F.element_at(names, F.col("_nr") + 1).alias("tag_name"), "value"))


def ingest_counters(rows: DataFrame, tag_names, mapped_names) -> DataFrame:
    """One-row quality summary of an upload (P7), computed in one pass before filtering.

    A row's cells are one array, so the expression stays flat however many tags the sheet has.  Cells
    of unmapped tags are counted as missing; a text sheet has no other kind of empty cell than the
    missing-value tokens, so ``none_values`` is zero."""
    mapped = set(mapped_names)
    known = [n in mapped for n in tag_names]
    n_mapped, unmapped = sum(known), len(known) - sum(known)
    array = F.col("cells")
    if unmapped:
        mask = F.array(*[F.lit(k) for k in known])
        array = F.filter(array, lambda c, i: F.element_at(mask, i + 1))
    missing = F.size(F.filter(array, lambda c: c.isNull()))
    zeros = F.size(F.filter(array, lambda c: c.try_cast("double") == 0))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    out = rows.select(missing.alias("_missing"), zeros.alias("_zeros")).agg(
        F.count(F.lit(1)).alias("row_count"), total(F.lit(n_mapped), "total_values"), total("_zeros", "zero_values"),
        total("_missing", "nan_values"), F.lit(0).cast("bigint").alias("none_values"),
        total(F.lit(unmapped), "missing_tag_values"))
    return (out.withColumn("prepared_records", F.col("total_values") - F.col("nan_values"))
            .withColumn("expected_records", F.col("row_count") * F.lit(n_mapped + unmapped).cast("bigint")))


def upsert_tags(existing: DataFrame, upload_meta: DataFrame, frequency: str | None,
                plant_id: int = 1, data_source_id: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """Tag get-or-create (M1) with the default description.

    ``existing``: ``tags(id, name, description, unit_of_measure, plant_id, is_active, data_source_id)``;
    ``upload_meta``: ``(name, description, unit)``.  Missing names get ids ``max(id)+1 ...``
    in name order; existing tags keep their description.  Returns
    ``(mapping(name, id, is_new), tags_after)``."""
    from ferrule.operators.ordinal import with_global_ordinal

    desc = F.coalesce(F.col("description"),
                      F.lit(DEFAULT_DESCRIPTION % frequency if frequency else None))
    upload = upload_meta.select("name", desc.alias("description"), F.col("unit").alias("unit_of_measure"))
    new = upload.join(existing.select("name"), "name", "left_anti")
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base")).first()["base"]
    new = with_global_ordinal(new, ["name"], name="_ord", start=int(base) + 1)
    new_tags = new.select(
        F.col("_ord").cast("int").alias("id"), "name", "description",
        "unit_of_measure", F.lit(plant_id).alias("plant_id"), F.lit(True).alias("is_active"),
        F.lit(data_source_id).alias("data_source_id"))
    tags_after = existing.select(*new_tags.columns).unionByName(new_tags)
    mapping = (upload.select("name").join(tags_after.select("name", "id"), "name")
               .join(new_tags.select("name", F.lit(True).alias("is_new")), "name", "left")
               .select("name", "id", F.coalesce("is_new", F.lit(False)).alias("is_new")))
    return mapping, tags_after


def map_tags(long: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name -> id (J4).  Returns ``(mapped rows with tag_id, unknown-name counts)``."""
    m = mapping.select(F.col("name").alias("tag_name"), F.col("id").alias("tag_id"))
    mapped = long.join(m, "tag_name")
    unknown = long.join(m, "tag_name", "left_anti").groupBy("tag_name").agg(F.count(F.lit(1)).alias("rows"))
    return mapped, unknown


def missing_tags(upload_names: DataFrame, mapped_names: DataFrame) -> DataFrame:
    """Uploaded names minus mapped names (U1), set semantics."""
    return upload_names.select("name").subtract(mapped_names.select("name"))


def series_rows(mapped: DataFrame, frequency: str | None, quality: str = "GOOD") -> DataFrame:
    """Melted, mapped readings in ``time_series`` layout plus the source line for keep-first."""
    return mapped.select("tag_id", "timestamp", "value", F.lit(frequency).alias("frequency"),
                         F.lit(quality).alias("quality"), F.col("_line").alias("src_row"))


def oldest_active_source(data_sources: DataFrame) -> DataFrame:
    """Per plant, the oldest active data source (W5): ``plant_id, data_source_id``."""
    return (data_sources.filter("is_active").groupBy("plant_id")
            .agg(F.min(F.struct(F.col("created_at").isNotNull().alias("dated"), "created_at", "id")).alias("_first"))
            .select("plant_id", F.col("_first.id").alias("data_source_id")))


# The source created for file uploads.
DEFAULT_SOURCE = {"type": "file", "name": "Default File Upload", "description": "Default source for file uploads"}


def default_sources(plants: DataFrame, data_sources: DataFrame, created_at) -> DataFrame:
    """Get-or-create the default source for every plant at once (M3): existing oldest
    active source, else a new row with id after the current max and ``created_at``."""
    from ferrule.functions.timebucket import ntz
    from ferrule.operators.ordinal import with_global_ordinal

    have = oldest_active_source(data_sources)
    need = plants.select(F.col("id").alias("plant_id")).join(have, "plant_id", "left_anti")
    base = data_sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base")).first()["base"]
    need = with_global_ordinal(need, ["plant_id"], name="_ord", start=int(base) + 1)
    stamp = F.lit(None).cast("timestamp_ntz") if created_at is None else ntz(created_at)
    created = need.select("plant_id", F.col("_ord").cast("int").alias("data_source_id"), F.lit(True).alias("created"),
                          *[F.lit(v).alias(k) for k, v in DEFAULT_SOURCE.items()], stamp.alias("created_at"))
    return have.withColumn("created", F.lit(False)).unionByName(created, allowMissingColumns=True)
