"""Chunk summaries of the stored layout: row counts, spans and frequencies without reading a series file.

A summary row is ``plant_id, width, chunk, tag_id, frequency, rows, first, last`` -- a mergeable state: rows of
one chunk and tag add up over any number of writes.  It lies in ``<layout>/_summary``, partitioned as the layout
(readers of the layout skip the folder), and is kept by every write, merge, delete and retention once it was made.

A write that changes data first leaves a mark; the mark goes when the summary is written too.  Where a mark is found,
a write stopped in between, and the summary is made anew from the data.  One writer at a time, as for the layout.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.timebucket import ntz

PLACE = ["plant_id", "width", "chunk"]
SCHEMA = ("tag_id int, frequency string, rows bigint, first timestamp_ntz, last timestamp_ntz, plant_id int, width bigint, "
          "chunk bigint")


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/_summary"


def _mark(path: str) -> str:
    return f"{path.rstrip('/')}/_summary_open"


def _exists(spark: SparkSession, path: str) -> bool:
    from ferrule.sources.storage import _fs

    fs, hpath, _ = _fs(spark, path)
    return fs.exists(hpath)


def has_summary(spark: SparkSession, path: str) -> bool:
    return _exists(spark, _folder(path)) or _exists(spark, _mark(path))


def states(rows: DataFrame) -> DataFrame:
    """Summary rows of layout rows (with their place); rows without a ``frequency`` column have the label NULL."""
    label = F.col("frequency") if "frequency" in rows.columns else F.lit(None)
    return (rows.groupBy(*PLACE, F.col("tag_id").cast("int").alias("tag_id"), label.cast("string").alias("frequency"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")))


def open_mark(spark: SparkSession, path: str) -> str:
    """Note that the layout changes; returns the mark for ``close_mark``."""
    from ferrule.sources.storage import _fs

    name = f"{_mark(path)}/{uuid.uuid4().hex}"
    fs, hpath, _ = _fs(spark, name)
    fs.mkdirs(hpath)
    return name


def close_mark(spark: SparkSession, path: str, name: str) -> None:
    from ferrule.sources.storage import _fs

    fs, hpath, _ = _fs(spark, name)
    fs.delete(hpath, True)
    fs, root, _ = _fs(spark, _mark(path))
    if fs.exists(root) and not fs.listStatus(root):
        fs.delete(root, True)


def write_states(rows: DataFrame, path: str, replace_chunks: bool = False) -> None:
    """Add summary rows, or put them in place of those of their chunks."""
    writer = rows.select("tag_id", "frequency", "rows", "first", "last", *PLACE).repartitionByRange(*PLACE).write
    if replace_chunks:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    writer.partitionBy(*PLACE).parquet(_folder(path))
    rows.sparkSession.catalog.refreshByPath(_folder(path))


def drop_chunk(spark: SparkSession, path: str, plant: str, width: int, chunk: int) -> None:
    """Forget a chunk that was removed from the layout (``plant`` is its folder's name)."""
    from ferrule.sources.storage import _fs

    fs, hpath, _ = _fs(spark, f"{_folder(path)}/{plant}/width={width}/chunk={chunk}")
    fs.delete(hpath, True)


def make_summary(spark: SparkSession, path: str) -> None:
    """Make the summary of a layout from its data."""
    from ferrule.sources.storage import _fs

    mark = open_mark(spark, path)
    fs, folder, _ = _fs(spark, _folder(path))
    fs.delete(folder, True)
    write_states(states(spark.read.parquet(path)), path)
    fs, marks, _ = _fs(spark, _mark(path))
    fs.delete(marks, True)
    close_mark(spark, path, mark)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of a layout; made first where it is missing or a write was stopped."""
    if _exists(spark, _mark(path)) or not _exists(spark, _folder(path)):
        make_summary(spark, path)
    return spark.read.schema(SCHEMA).parquet(_folder(path))


# --- answers ------------------------------------------------------------------------------

def layout_counts(spark: SparkSession, path: str) -> DataFrame:
    """S9/A14 per tag: ``tag_id, rows, first, last, chunks``."""
    return (read_summary(spark, path).groupBy("tag_id")
            .agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"),
                 F.count_distinct(*PLACE).alias("chunks")))


def history_of_layout(spark: SparkSession, path: str, tags: DataFrame, plant_id=None, limit: int = 20) -> DataFrame:
    """Count, first and last reading per (tag name, frequency), newest first."""
    t = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"), F.col("plant_id").alias("_plant"))
    if plant_id is not None:
        t = t.filter(F.col("_plant") == plant_id)
    out = (read_summary(spark, path).groupBy("tag_id", "frequency")
           .agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
           .join(t.drop("_plant"), "tag_id").groupBy("tag_name", "frequency")
           .agg(F.sum("rows").alias("records_count"), F.min("first").alias("first_record"), F.max("last").alias("last_record")))
    return out.orderBy(F.col("last_record").desc(), "tag_name", "frequency").limit(limit)


def _frequencies_in(spark: SparkSession, path: str, lo, hi) -> DataFrame:
    """Distinct ``(tag_id, frequency)`` of the rows in ``[lo, hi]``.

    A summary row whose first or last reading lies in the span answers for itself.  One that
    reaches over both ends may have no reading inside: only its chunks are looked up in the data."""
    inside = lambda c: F.col(c).between(ntz(lo), ntz(hi))
    near = read_summary(spark, path).filter((F.col("first") <= ntz(hi)) & (F.col("last") >= ntz(lo)))
    sure = near.filter(inside("first") | inside("last")).select("tag_id", "frequency").distinct()
    open_ = near.filter(~(inside("first") | inside("last"))).select("tag_id", "frequency", *PLACE)
    same = F.col("o.tag_id").eqNullSafe(F.col("s.tag_id")) & F.col("o.frequency").eqNullSafe(F.col("s.frequency"))
    open_ = open_.alias("o").join(sure.alias("s"), same, "left_anti")
    chunks = open_.select(*PLACE).distinct().collect()  # folders
    if not chunks:
        return sure
    place = F.struct(*PLACE).isin([F.struct(*[F.lit(c[p]) for p in PLACE]) for c in chunks])
    rows = spark.read.parquet(path).where(place & inside("timestamp"))
    label = F.col("frequency") if "frequency" in rows.columns else F.lit(None)
    return sure.union(rows.select(F.col("tag_id").cast("int"), label.cast("string").alias("frequency"))).distinct()


def conflicts_of_layout(spark: SparkSession, path: str, upload_names: DataFrame, span, upload_frequency: str | None,
                        tags: DataFrame) -> DataFrame:
    """A10 from the summary: ``tag_name, existing_frequency, existing_frequencies, new_frequency`` of the uploaded tags whose
    stored rows in the upload's span carry other frequencies only."""
    from ferrule.operators.frequency import frequency_conflicts

    lo, hi = span
    found = _frequencies_in(spark, path, lo, hi) if lo is not None else read_summary(spark, path).select("tag_id", "frequency").limit(0)
    return frequency_conflicts(upload_names, span, upload_frequency, found.withColumn("timestamp", ntz(lo) if lo is not None else F.lit(None)), tags)



def newest_bound(spark: SparkSession, path: str, start=None, end=None, limit: int = 100, tag_ids=None):
    """A time at or after which ``limit`` rows of the range certainly lie, or ``start``.

    Chunks whose rows all lie in the range are counted from the newest on, by their summary; a chunk that reaches over an
    end of the range counts for nothing."""
    rows = read_summary(spark, path)
    if tag_ids is not None:
        rows = rows.filter(F.col("tag_id").isin(list(tag_ids)))
    chunks = rows.groupBy(*PLACE).agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
    if start is not None:
        chunks = chunks.filter(F.col("first") >= ntz(start))
    if end is not None:
        chunks = chunks.filter(F.col("last") <= ntz(end))
    held, since = 0, None
    for c in chunks.filter(F.col("first").isNotNull()).orderBy(F.col("first").desc()).toLocalIterator():  # folders
        held, since = held + c["rows"], c["first"]
        if held >= limit:
            return since
    return start


def latest_of_layout(spark: SparkSession, path: str, start=None, end=None, limit: int = 100, tag_ids=None) -> DataFrame:
    """F1 on the stored layout: newest first, top ``limit``.  Only the chunks that reach ``newest_bound`` are read; rows
    before it cannot be among the newest."""
    from ferrule.operators.metrics import latest_readings
    from ferrule.sources.storage import read_series

    since = newest_bound(spark, path, start, end, limit, tag_ids)
    return latest_readings(read_series(spark, path, since, end, tag_ids), limit=limit)
