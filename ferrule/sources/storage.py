"""Stored ``time_series`` layout and table-level sources / sinks.

Layout (S12): Parquet + zstd, partitioned by ``plant_id``, ``width`` (chunk width in seconds,
from the data frequency, S13) and ``chunk`` (chunk start in epoch seconds), rows sorted
by ``(tag_id, timestamp)`` inside each file -- the column-store analogue of
"segment by tag, order by time".  The writer range-partitions on
``(plant_id, chunk, tag_id, timestamp)`` so one huge chunk or tag is split over
many tasks and files instead of landing in one.

The width is part of every row's partition, so uploads of different frequencies share one table, and
reads, merges, retention and compaction never have to be told it.  Reads (F1/F2/M2) add the chunk
predicate implied by a timestamp range (a chunk overlaps it when it starts before the range ends and
ends after the range starts), so the scan shows ``PartitionFilters`` as well as pushed
``timestamp`` filters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.timebucket import FIXED_ORIGIN, minus_interval, parse_interval, time_bucket
from ferrule.operators.frequency import CHUNK_INTERVALS, DEFAULT_CHUNK_INTERVAL

EPOCH = dt.datetime(1970, 1, 1)
_ORIGIN = dt.datetime.fromisoformat(FIXED_ORIGIN)

# Import whitelist and its conflict keys.
IMPORT_TABLES = {"time_series": ("tag_id", "timestamp"), "tags": ("name",), "polling_tasks": ("id",)}
SPLIT_ROWS = 500_000


def chunk_width(frequency: str | None) -> str:
    return CHUNK_INTERVALS.get(frequency, DEFAULT_CHUNK_INTERVAL)


def chunk_of(ts, interval: str) -> int:
    """Python twin of the chunk column for literal bounds (fixed-width chunks only)."""
    width = parse_interval(interval).micros
    ts = dt.datetime.fromisoformat(str(ts))
    off = (ts - _ORIGIN) // dt.timedelta(microseconds=1)
    start = _ORIGIN + dt.timedelta(microseconds=off - off % width)
    return int((start - EPOCH).total_seconds())


def with_chunk(df: DataFrame, interval: str, ts: str = "timestamp") -> DataFrame:
    start = time_bucket(interval, ts)
    return df.withColumn("chunk", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                                   start))


def _write_layout(df: DataFrame, path: str, mode: str, max_records_per_file: int) -> None:
    """Write rows that carry ``plant_id``, ``width`` and ``chunk``; ``mode`` "overwrite" replaces the
    table and "partitions" the partitions that occur, whatever the session's setting."""
    writer = (df.repartitionByRange("plant_id", "width", "chunk", "tag_id", "timestamp")
              .sortWithinPartitions("plant_id", "width", "chunk", "tag_id", "timestamp")
              .write.mode("append" if mode == "append" else "overwrite")
              .option("maxRecordsPerFile", max_records_per_file))
    if mode != "append":
        writer = writer.option("partitionOverwriteMode", "dynamic" if mode == "partitions" else "static")
    writer.partitionBy("plant_id", "width", "chunk").parquet(path)


def write_series(df: DataFrame, path: str, frequency: str | None = None, interval: str | None = None,
                 mode: str = "append", max_records_per_file: int = 5_000_000, with_summary: bool = False) -> str:
    """Write ``time_series`` rows in the chunked layout; returns the chunk width used.

    A layout that has a summary (``summary.py``) keeps it; ``with_summary`` makes one with the first write."""
    from ferrule.session import cut_lineage
    from ferrule.sources import summary

    spark = df.sparkSession
    keep = with_summary or (mode == "append" and summary.has_summary(spark, path))
    interval = interval or chunk_width(frequency)
    width = parse_interval(interval).micros // 1_000_000
    out = with_chunk(df, interval).withColumn("width", F.lit(width).cast("bigint"))
    if "plant_id" not in out.columns:
        out = out.withColumn("plant_id", F.lit(1))
    if not keep:
        _write_layout(out, path, mode, max_records_per_file)
        return interval
    out = cut_lineage(out)  # read twice: by the layout and by its summary
    if mode == "append" and _fs(spark, path)[0].exists(_fs(spark, path)[1]) and not summary.has_summary(spark, path):
        summary.make_summary(spark, path)
    mark = summary.open_mark(spark, path) if mode == "append" else None
    _write_layout(out, path, mode, max_records_per_file)
    summary.write_states(summary.states(out), path)
    if mark:
        summary.close_mark(spark, path, mark)
    return interval


def _seconds(ts) -> int:
    return int((dt.datetime.fromisoformat(str(ts)) - EPOCH).total_seconds() // 1)


def read_series(spark: SparkSession, path: str, start=None, end=None, tag_ids=None, plant_id=None) -> DataFrame:
    """Read the layout with the implied chunk predicate (partition pruning) plus the
    inclusive timestamp range and tag predicates (row-group pruning), over chunks of any width.
    Text bounds may be ISO-8601 with a ``Z`` / offset suffix (dropped, wall clock kept)."""
    from ferrule.functions.timebucket import iso_bound, ntz

    start = iso_bound(start) if isinstance(start, str) else start
    end = iso_bound(end) if isinstance(end, str) else end
    df = spark.read.parquet(path)
    if plant_id is not None:
        df = df.filter(F.col("plant_id") == plant_id)
    if start is not None:
        df = df.filter((F.col("chunk") + F.col("width") > _seconds(start)) & (F.col("timestamp") >= ntz(start)))
    if end is not None:
        df = df.filter((F.col("chunk") <= _seconds(end)) & (F.col("timestamp") <= ntz(end)))
    if tag_ids is not None:
        df = df.filter(F.col("tag_id").isin(list(tag_ids)))
    return df


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm


def _chunk_folders(spark: SparkSession, path: str):
    """(plant folder, width, chunk start, path, file system, JVM) of every stored chunk; only listings
    reach the driver."""
    fs, root, jvm = _fs(spark, path)

    def below(parent, prefix):
        for item in fs.listStatus(parent):
            name = item.getPath().getName()
            if item.isDirectory() and name.startswith(prefix):
                yield name.split("=", 1)[1], item.getPath()

    for plant, plant_path in below(root, "plant_id="):
        for width, width_path in below(plant_path, "width="):
            for chunk, chunk_path in below(width_path, "chunk="):
                yield f"plant_id={plant}", int(width), int(chunk), chunk_path, fs, jvm


def drop_days(spark: SparkSession, path: str, first: str, end: str, keep=()) -> None:
    """Delete the ``day=`` folders of a daily table in ``[first, end)`` that are not in ``keep``."""
    fs, root, jvm = _fs(spark, path)
    for item in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "day=*")) or []:
        day = item.getPath().getName()[len("day="):]
        if first <= day < end and day not in keep:
            fs.delete(item.getPath(), True)
    spark.catalog.refreshByPath(path)


def delete_from_layout(spark: SparkSession, path: str, keys: DataFrame, rollup: str | None = None) -> DataFrame:
    """Delete the rows of ``keys(tag_id, timestamp)`` from the stored layout and return them.

    Only the chunks that hold such rows are rewritten; a chunk that loses all its rows is removed.  With ``rollup`` the
    touched days are entered into that rollup's ledger before the delete, so a stop in between costs a refresh for nothing and
    never a stale day."""
    from ferrule.operators.rollup import record_touched
    from ferrule.session import cut_lineage
    from ferrule.sources import summary

    wanted = cut_lineage(keys.select("tag_id", "timestamp").distinct())
    span = wanted.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
    if span["lo"] is None:
        return read_series(spark, path).limit(0)
    place = ["plant_id", "width", "chunk"]
    hit = cut_lineage(read_series(spark, path, span["lo"], span["hi"]).join(wanted, ["tag_id", "timestamp"], "left_semi"))
    chunks = hit.select(*place).distinct().collect()  # folders, as many as the listing has
    if rollup:
        record_touched(hit, rollup)
    keep = summary.has_summary(spark, path)
    mark = summary.open_mark(spark, path) if keep and chunks else None
    if chunks:
        in_chunks = F.struct(*place).isin([F.struct(F.lit(c["plant_id"]), F.lit(c["width"]), F.lit(c["chunk"])) for c in chunks])
        left = cut_lineage(spark.read.parquet(path).where(in_chunks).join(wanted, ["tag_id", "timestamp"], "left_anti"))
        _write_layout(left, path, "partitions", 5_000_000)
        if keep:
            summary.write_states(summary.states(left), path, replace_chunks=True)
        full = {tuple(r) for r in left.select(*place).distinct().collect()}
        fs, root, jvm = _fs(spark, path)
        for c in chunks:
            if tuple(c) not in full:
                if keep:
                    summary.drop_chunk(spark, path, f"plant_id={c['plant_id']}", c["width"], c["chunk"])
                fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"plant_id={c['plant_id']}/width={c['width']}/chunk={c['chunk']}"), True)
        spark.catalog.refreshByPath(path)
    if mark:
        summary.close_mark(spark, path, mark)
    return hit


def drop_expired_chunks(spark: SparkSession, path: str, as_of, keep: str = "3 months", rollup: str | None = None) -> list:
    """Retention (R1) on the stored layout: delete whole chunk directories whose end, by their own
    stored width, is at or before ``as_of - keep``.  With ``rollup`` their days are entered into that
    rollup's ledger first."""
    cutoff = minus_interval(as_of, keep)
    dropped = []
    if rollup:
        from ferrule.operators.rollup import record_touched

        limit = int((cutoff - EPOCH).total_seconds() // 1)
        record_touched(spark.read.parquet(path).where(F.col("chunk") + F.col("width") <= limit), rollup)
    from ferrule.sources import summary

    for plant, width, start, folder, fs, _ in _chunk_folders(spark, path):
        if EPOCH + dt.timedelta(seconds=start + width) <= cutoff:
            fs.delete(folder, True)
            summary.drop_chunk(spark, path, plant, width, start)
            dropped.append((plant, start))
    return dropped


_MOVES = "moves array<struct<source: string, target: string>>, old array<string>"


def _finish_compaction(spark: SparkSession, path: str) -> None:
    """Carry out a compaction whose plan is written, or clear away one that stopped before its plan was.

    New files come in before the old ones go, and every step can be repeated."""
    plan, copy = (path.rstrip("/") + name for name in ("/_compaction", "/_compacting"))
    fs, root, jvm = _fs(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    if fs.exists(at(plan + "/_SUCCESS")):
        steps = spark.read.schema(_MOVES).json(plan).first()
        for move in steps["moves"] if steps else []:
            if fs.exists(at(move["source"])) and not fs.rename(at(move["source"]), at(move["target"])):
                raise OSError(f"{move['source']} could not be moved; run the compaction again")
        for name in steps["old"] if steps else []:
            fs.delete(at(name), False)
    fs.delete(at(copy), True)
    fs.delete(at(plan), True)


def _finish_swaps(spark: SparkSession, path: str) -> None:
    """Complete or undo chunk swaps of tables compacted folder by folder (an older form): an old copy goes once its
    chunk is in place, and comes back where it is not."""
    fs, root, jvm = _fs(spark, path)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "plant_id=*/width=*/_old_chunk=*"))
    for item in found or []:
        old = item.getPath()
        chunk = jvm.org.apache.hadoop.fs.Path(old.getParent(), old.getName()[len("_old_"):])
        if fs.exists(chunk):
            fs.delete(old, True)
        else:
            fs.rename(old, chunk)


def compact_chunks(spark: SparkSession, path: str, before) -> DataFrame:
    """Compaction (R2) in place: the chunks that end at or before ``before`` are rewritten in the sorted
    layout; later chunks are not touched.  Returns the rewritten chunks.

    Only the files that are there at the start are rewritten and later deleted, so what is appended meanwhile stays.  The
    rewritten files lie beside the table until a plan of all moves is written; from then on a rerun after a stop carries
    the plan out, before it the rerun starts anew.  While files are exchanged a reader may see rows twice, never too few."""
    _finish_swaps(spark, path)
    _finish_compaction(spark, path)
    limit = _seconds(before)
    done, files = [], []
    for plant, width, start, folder, fs, _ in _chunk_folders(spark, path):
        if start + width <= limit:
            done.append((int(plant.split("=", 1)[1]), width, start))
            files += [f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName()[0] not in "_."]
    if files:
        copy = path.rstrip("/") + "/_compacting"
        _write_layout(spark.read.option("basePath", path).parquet(*files), copy, "overwrite", 5_000_000)
        moves = []
        for plant, width, start, folder, fs, jvm in _chunk_folders(spark, copy):
            target = f"{path.rstrip('/')}/{plant}/width={width}/chunk={start}"
            moves += [(f.getPath().toString(), f"{target}/{f.getPath().getName()}") for f in fs.listStatus(folder)
                      if f.getPath().getName()[0] not in "_."]
        plan = spark.createDataFrame([(moves, files)], _MOVES)
        plan.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "/_compaction")
        _finish_compaction(spark, path)
    spark.catalog.refreshByPath(path)
    return spark.createDataFrame(done, "plant_id int, width bigint, chunk bigint")


def split_csv(df: DataFrame, out: str, rows_per_file: int = SPLIT_ROWS) -> None:
    """Write a large frame as CSV files of at most ``rows_per_file`` rows each."""
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(out)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Catalog tables as a DataFrame (the listing itself is catalog metadata)."""
    rows = [(t.name, t.database, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, database string, table_type string, is_temporary boolean")


def list_columns(df: DataFrame) -> DataFrame:
    """Column names and types of a table."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, is_nullable boolean")


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, lower=None, upper=None,
               num_partitions: int = 64, fetch_size: int = 1000, properties: dict | None = None) -> DataFrame:
    """Parallel JDBC scan (range-split on ``column``), ``fetchsize`` rows per round trip."""
    props = dict(properties or {})
    props["fetchsize"] = str(fetch_size)
    if column is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=props)


def import_tables(sources: dict, targets: dict, tables=None) -> dict:
    """Copy whitelisted tables into targets, skipping empty sources, ignoring key
    conflicts (existing row wins, then first source row).  ``sources``/``targets`` map
    table name -> DataFrame; returns name -> (inserted, snapshot)."""
    from ferrule.operators.merge import keep_first

    wanted = [t for t in (tables or IMPORT_TABLES) if t in IMPORT_TABLES]
    out = {}
    for name in wanted:
        src = sources.get(name)
        if src is None or src.isEmpty():
            continue
        keys = list(IMPORT_TABLES[name])
        order = "src_row" if "src_row" in src.columns else None
        if order is None:
            src = src.withColumn("src_row", F.monotonically_increasing_id())
        first = keep_first(src, keys, "src_row").drop("src_row")
        tgt = targets.get(name)
        if tgt is None:
            out[name] = (first, first)
            continue
        inserted = first.join(tgt.select(*keys), keys, "left_anti")
        out[name] = (inserted, tgt.unionByName(inserted, allowMissingColumns=True))
    return out


def merge_into_layout(spark: SparkSession, path: str, batch: DataFrame, interval: str,
                      order: str = "src_row", rollup: str | None = None) -> DataFrame:
    """M2 against the stored layout: keep-first inside the batch, drop keys already stored
    -- reading only the chunks the batch spans, of any width -- and append the new rows in chunks
    of ``interval``.  Returns the inserted rows (read back from what was written).  With ``rollup`` their days are
    entered into that rollup's ledger."""
    from ferrule.operators.merge import keep_first
    from ferrule.session import cut_lineage

    span = batch.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
    first = keep_first(batch, ["tag_id", "timestamp"], order)
    if span is None or span["lo"] is None:
        return first.limit(0)
    try:
        stored = read_series(spark, path, span["lo"], span["hi"]).select("tag_id", "timestamp")
        first = first.join(stored, ["tag_id", "timestamp"], "left_anti")
    except Exception as exc:  # noqa: BLE001 -- first write: nothing stored yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    inserted = cut_lineage(first.drop(order) if order in first.columns else first)
    if rollup:
        from ferrule.operators.rollup import record_touched

        record_touched(inserted, rollup)
    write_series(inserted, path, interval=interval, mode="append")
    return inserted
