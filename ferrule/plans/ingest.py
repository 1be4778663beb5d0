"""Upload flow: wide sheet -> detected frequency -> conflicts -> tags -> merged series.

Only one-row summaries (frequency, time span, max tag id) and the three sheet
metadata lines reach the driver; readings stay in Spark end to end.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.timebucket import time_bucket
from ferrule.operators import frequency as FQ
from ferrule.operators import ingest as I
from ferrule.operators import merge as MG
from ferrule.session import checkpoint_dir, cut_lineage, ensure_checkpoint_dir
from ferrule.sources.sheet import SheetError, read_sheet, read_sheets
from ferrule.sources.tables import read_table


@dataclass
class IngestResult:
    frequency: str | None
    conflicts: DataFrame
    mapping: DataFrame
    tags: DataFrame
    melted: DataFrame
    inserted: DataFrame
    snapshot: DataFrame
    counters: DataFrame
    unknown: DataFrame
    held: bool = False


def ingest_sheet(spark: SparkSession, path: str, existing_tags: DataFrame, stored: DataFrame,
                 plant_id: int = 1, on_conflict: str = "proceed", create_tags: bool = True) -> IngestResult:
    """Ingest one sheet.  An upload without a single reading is an error.  When stored rows of its tags
    in its time span carry another frequency, ``on_conflict="hold"`` inserts nothing and reports the
    conflicts (``held``); ``"proceed"`` reports them and merges.  Without ``create_tags`` a column whose name has no
    stored tag stays unmapped: its cells are counted and not inserted."""
    if on_conflict not in ("hold", "proceed"):
        raise ValueError("on_conflict is 'hold' or 'proceed'")
    sheet = read_sheet(spark, path)
    names = list(sheet.tag_columns)
    # parse the text once; every summary and the melt then read the typed rows
    rows = cut_lineage(I.sheet_rows(sheet))
    summary = FQ.frequency_of_frame(rows, "timestamp", with_span=True).first()  # one job
    frequency = summary["frequency"] if summary else None
    span = (summary["lo"], summary["hi"]) if summary else (None, None)
    upload_names = spark.createDataFrame([(n,) for n in names], "name string")
    conflicts = FQ.frequency_conflicts(upload_names, span, frequency, stored, existing_tags)
    mapping, tags_after = I.upsert_tags(existing_tags, sheet.metadata(spark), frequency, plant_id) if create_tags else (
        I.known_tags(existing_tags, upload_names), existing_tags)
    long = I.melt(rows, names)
    if long.isEmpty():  # Fixed value: the message
        raise SheetError("No valid data to insert.")
    mapped, unknown = I.map_tags(long, mapping)
    batch = I.series_rows(mapped, frequency)
    held = on_conflict == "hold" and not conflicts.isEmpty()
    inserted, snapshot = MG.merge_append(stored, batch.limit(0) if held else batch, span=span)
    mapped_names = names if create_tags else [r["name"] for r in mapping.select("name").collect()]  # of one sheet's columns
    counters = I.ingest_counters(rows, names, mapped_names)
    return IngestResult(frequency, conflicts, mapping, tags_after, long, inserted, snapshot, counters, unknown, held)


@dataclass
class FolderResult:
    """``files``: ``file, frequency, lo, hi``; ``rejected``: ``file, reason``; ``counters``: a row per file."""

    files: DataFrame
    rejected: DataFrame
    mapping: DataFrame
    tags: DataFrame
    melted: DataFrame
    inserted: DataFrame
    snapshot: DataFrame
    counters: DataFrame


def ingest_sheets(spark: SparkSession, path: str, existing_tags: DataFrame, stored: DataFrame, plant_id: int = 1,
                  create_tags: bool = True) -> FolderResult:
    """Ingest a folder of sheets in one flow: frequency, order of day and month, and counters are those of each file.

    Of a reading that several files hold, the one of the first file (by name) and line is stored; a tag that several files
    describe is made from the first of them.  Files without a time column or without a parseable timestamp are reported
    as rejected, the others are ingested."""
    sheets = read_sheets(spark, path)
    parsed = cut_lineage(I.folder_rows(sheets))
    rows = parsed.where(F.col("timestamp").isNotNull())
    bad = (sheets.heads.select("file").join(rows.select("file").distinct(), "file", "left_anti")
           .select("file", F.lit("No value of the time column could be converted to datetime.").alias("reason")))
    spans = rows.groupBy("file").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    files = cut_lineage(FQ.frequency_by_key(rows.select("file", "timestamp"), ["file"]).select("file", "frequency").join(spans, "file"))
    tag = sheets.heads.join(files, "file").select("file", "frequency", F.explode("tags").alias("t"))
    described = F.coalesce("t.description", F.when(F.col("frequency").isNotNull(), F.format_string(I.DEFAULT_DESCRIPTION, "frequency")))
    meta = cut_lineage(tag.groupBy(F.col("t.name").alias("name")).agg(
        F.min_by(F.struct(described.alias("description"), F.col("t.unit").alias("unit")), "file").alias("m")).select("name", "m.*"))
    mapping, tags_after = I.upsert_tags(existing_tags, meta, None, plant_id) if create_tags else (
        I.known_tags(existing_tags, meta), existing_tags)
    mapping = cut_lineage(mapping)
    cells = rows.select("file", "_line", "timestamp", F.explode(F.arrays_zip("names", "cells")).alias("c")).select(
        "file", "_line", "timestamp", F.col("c.names").alias("tag_name"), F.col("c.cells").alias("value"))
    long = cells.where(F.col("value").isNotNull())
    mapped, _ = I.map_tags(long, mapping)
    batch = mapped.join(files.select("file", "frequency"), "file").select(
        "tag_id", "timestamp", "value", "frequency", F.lit("GOOD").alias("quality"), F.struct("file", "_line").alias("src_row"))
    inserted, snapshot = MG.merge_append(stored, batch)
    counters = I.folder_counters(rows, cells, mapping)
    return FolderResult(files, sheets.rejected.union(bad), mapping, tags_after, long, inserted, snapshot, counters)


# ---------------------------------------------------------------------------
# A wide sheet derived from the driver's ``events`` table
# ---------------------------------------------------------------------------

# Extra sheet columns that exercise duplicate headers, blank columns, new tags.
EXTRA_DUPLICATE = "view"
EXTRA_BLANK = "spare"
EXTRA_NEW = "total"


def events_sheet(spark: SparkSession, sf_dir: str, out_dir: str | None = None) -> str:
    """Write the hourly wide sheet of ``events`` as one header-less CSV and return its path.

    Cells are the hourly max reading per event type; a second ``view`` column (hourly min),
    an all-blank ``spare`` column and an hourly ``total`` count follow.  The sheet has one
    line per hour, so its size is bounded by the time span, not by the event count; that
    bound is what makes the single output file acceptable here.
    """
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    types = [r["event_type"] for r in ev.select("event_type").distinct().orderBy("event_type").collect()]
    hour = time_bucket("1 hour", "ts").alias("hour")
    wide = (ev.groupBy(hour).pivot("event_type", types)
            .agg(F.max("value")))
    mins = ev.filter(F.col("event_type") == EXTRA_DUPLICATE).groupBy(hour).agg(F.min("value").alias("_dup"))
    total = ev.groupBy(hour).agg(F.count(F.lit(1)).alias("_total"))
    wide = wide.join(mins, "hour", "left").join(total, "hour", "left")
    header = ["timestamp"] + types + [EXTRA_DUPLICATE, EXTRA_BLANK, EXTRA_NEW]
    desc = [""] + [f"Event type {t}" for t in types] + ["", "", ""]
    units = [""] + ["units" if i % 2 == 0 else "" for i in range(len(types))] + ["", "", "count"]
    ncol = len(header)
    data = wide.select(
        F.timestamp_diff("SECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col("hour")).alias("_k"),
        F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("c0"),
        *[F.col(f"`{t}`").cast("string").alias(f"c{i + 1}") for i, t in enumerate(types)],
        F.col("_dup").cast("string").alias(f"c{len(types) + 1}"),
        F.lit(None).cast("string").alias(f"c{len(types) + 2}"),
        F.col("_total").cast("string").alias(f"c{len(types) + 3}"),
    )
    meta = spark.createDataFrame(
        [(-3 + i, *vals) for i, vals in enumerate([header, desc, units])],
        "_k long, " + ", ".join(f"c{i} string" for i in range(ncol)))
    base = out_dir or os.path.join(ensure_checkpoint_dir(spark) or checkpoint_dir(spark), "sheets")
    path = os.path.join(base, f"events-sheet-{uuid.uuid4().hex[:12]}")
    (meta.unionByName(data).repartition(1).sortWithinPartitions("_k").drop("_k")
     .write.option("header", False).option("emptyValue", "").csv(path))
    return path


# Users on a sheet, and the time layouts that sheets are written in, by turn.
SHEET_USERS = 10
SHEET_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "d/M/yyyy H:m:s", "M/d/yyyy H:m:s")
# Fixed value: folders that the sheets are dealt over; Spark lists a folder in one task, with all below it.
SHELVES = 100


def user_sheets(spark: SparkSession, sf_dir: str, out_dir: str | None = None) -> str:
    """Write ``events`` as a folder of sheets, one per ten users: a column per user and a line per event.

    Descriptions hold a quoted line break and commas; time texts are ISO, day first or month first by sheet."""
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "value", "event_id"])
    block, place = F.floor(F.col("user_id") / SHEET_USERS).cast("int"), (F.col("user_id") % SHEET_USERS).cast("int")
    layout = F.lit(None).cast("string")
    for k, pattern in enumerate(SHEET_LAYOUTS):
        layout = F.when(block % len(SHEET_LAYOUTS) == k, F.date_format("ts", pattern)).otherwise(layout)
    lines = ev.select(block.alias("block"), F.col("event_id").alias("k"), F.concat(
        layout, F.repeat(F.lit(","), place + 1), F.col("value").cast("string"), F.repeat(F.lit(","), SHEET_USERS - 1 - place)).alias("value"))
    users = F.transform(F.sequence(F.lit(0), F.lit(SHEET_USERS - 1)), lambda i: F.col("block") * SHEET_USERS + i)
    head = lambda cell: F.concat_ws(",", F.transform(users, cell))
    line = lambda k, text: F.struct(F.lit(k).cast("bigint").alias("k"), text.alias("value"))
    described = F.concat(F.lit('"Readings,\nof ""user"" '), F.lit("%s"), F.lit('"'))
    top = lines.select("block").distinct().withColumn("l", F.explode(F.array(
        line(-3, F.concat(F.lit("Timestamp,"), head(lambda u: F.concat(F.lit("User_"), u.cast("string"))))),
        line(-2, F.concat(F.lit(","), head(lambda u: F.when(u % 3 == 0, F.lit("")).otherwise(F.replace(described, F.lit("%s"), u.cast("string")))))),
        line(-1, F.concat(F.lit(","), head(lambda u: F.when(u % 2 == 0, F.lit("units")).otherwise(F.lit("NaN"))))))))
    top = top.select("block", "l.k", "l.value")
    base = out_dir or os.path.join(ensure_checkpoint_dir(spark) or checkpoint_dir(spark), "sheets")
    path = os.path.join(base, f"user-sheets-{uuid.uuid4().hex[:12]}")
    (lines.unionByName(top).withColumn("shelf", F.pmod("block", F.lit(SHELVES)))
     .repartition("block").sortWithinPartitions("shelf", "block", "k").drop("k")
     .write.partitionBy("shelf", "block").text(path))
    return path
