"""Readers: the wide sensor sheet (S1-S3) and generic CSV / XML / JSON records.

A sensor sheet is header-less text: line 0 holds ``timestamp, tag1, tag2, ...``,
line 1 descriptions, line 2 units, lines 3+ readings.  Every cell is read as
text (no schema inference), so the later melt never meets mixed types.

The source line number is ``monotonically_increasing_id()`` taken right at
the scan: it grows with the file offset (splits of one file are planned in
offset order), is stable when a task is retried, and needs no extra job.
Only the three metadata lines reach the driver -- their size is bounded by
the number of columns, never by the number of readings.  One sheet is one
file; ``read_sheets`` reads a folder of them, each with its own header, in one job.

Quotes are doubled inside quoted cells, and a quoted cell may hold line breaks.  Whether any does is found out
first (a line with an odd number of quotes): only then a file is read by one task, otherwise in splits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cell texts read as missing (the pandas CSV defaults).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class SheetError(ValueError):
    """A sheet that cannot be ingested (no time column, no parseable timestamp ...)."""


@dataclass
class Sheet:
    """A parsed sheet: metadata per tag column and the data lines (all text)."""

    data: DataFrame                      # _line, ts_text, <tag columns...> (positional _cN names)
    time_column: str                     # lower-cased header of the timestamp column
    tag_columns: dict = field(default_factory=dict)   # tag name -> [positional column names]
    descriptions: dict = field(default_factory=dict)  # tag name -> description or None
    units: dict = field(default_factory=dict)         # tag name -> unit or None

    def metadata(self, spark: SparkSession) -> DataFrame:
        """``(col_idx, name, description, unit)`` -- one row per tag name (first column wins)."""
        rows = []
        for name, cols in self.tag_columns.items():
            rows.append((int(cols[0][2:]), name, self.descriptions.get(name), self.units.get(name)))
        return spark.createDataFrame(rows, "col_idx int, name string, description string, unit string")


def na_to_null(col):
    return F.when(F.trim(col).isin(list(NA_TOKENS)) | col.isNull(), F.lit(None)).otherwise(col)


def _meta_text(v):
    """Description / unit cell: kept when it is non-blank text, else None."""
    if v is None:
        return None
    return v if str(v).strip() and str(v).strip() not in NA_TOKENS else None


def _text_shape(spark: SparkSession, path: str, sep: str) -> tuple[int, bool]:
    """Most cells on a line, and whether quoted cells span lines (one aggregate over the text)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    cells = F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit(""))) + 1
    row = spark.read.text(path).agg(F.max(cells), F.bool_or(quotes % 2 == 1)).first()
    return row[0] or 0, bool(row[1])


def _cells_reader(spark: SparkSession, sep: str, spans_lines: bool):
    return (spark.read.option("header", False).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("multiLine", spans_lines).option("mode", "PERMISSIVE"))


def read_sheet(spark: SparkSession, path: str, sep: str = ",") -> Sheet:
    _, spans_lines = _text_shape(spark, path, sep)
    raw = _cells_reader(spark, sep, spans_lines).option("inferSchema", False).csv(path)
    raw = raw.withColumn("_line", F.monotonically_increasing_id())
    # splits of one file are planned in offset order and a limit scans partition 0
    # first, so this reads only the first split, not the whole file
    head = sorted(raw.limit(3).collect(), key=lambda r: r["_line"])
    if not head:
        raise SheetError("empty sheet")
    while len(head) < 3:
        head.append(None)
    positional = [c for c in raw.columns if c != "_line"]
    names = {}
    for c in positional:
        v = head[0][c]
        names[c] = None if v is None else str(v).strip().lower()
    time_cols = [c for c in positional if names[c] and "time" in names[c]]
    if not time_cols:
        raise SheetError("No timestamp column found in the data.")
    tcol = time_cols[0]
    tag_columns, desc, unit = {}, {}, {}
    for c in positional:
        n = names[c]
        if c == tcol or not n or n in NA_TOKENS:
            continue
        if n == names[tcol]:
            continue
        tag_columns.setdefault(n, []).append(c)
        # of equal names the last column's description and unit stay
        desc[n] = _meta_text(head[1][c]) if head[1] is not None else None
        unit[n] = _meta_text(head[2][c]) if head[2] is not None else None
    first_data_line = head[2]["_line"] if head[2] is not None else None
    data = raw if first_data_line is None else raw.filter(F.col("_line") > F.lit(first_data_line))
    data = data.select("_line", F.col(tcol).alias("ts_text"), *[c for cs in tag_columns.values() for c in cs])
    return Sheet(data, names[tcol], tag_columns, desc, unit)


@dataclass
class Sheets:
    """The sheets of a folder.  ``heads``: ``file, time_column, time_at, tags`` (``name, places, description, unit``
    per distinct tag name, places being cell numbers) and ``first_line``; ``data``: ``file, _line, ts_text, names, cells`` of the data lines, a cell per
    name; ``rejected``: ``file, reason`` of files without a time column."""

    heads: DataFrame
    data: DataFrame
    rejected: DataFrame


def read_sheets(spark: SparkSession, path: str, sep: str = ",") -> Sheets:
    """Read many sheets at once, by the rules of ``read_sheet``.

    A file's header is one row joined to its lines by file name (by broadcast only where the headers
    of all files are small); nothing is collected.  The lines are parsed once and written, as opening many
    files and parsing them costs more than any later step."""
    from ferrule.session import cut_lineage

    width, spans_lines = _text_shape(spark, path, sep)
    columns = [f"c{i}" for i in range(max(width, 1))]
    raw = cut_lineage(_cells_reader(spark, sep, spans_lines).schema(", ".join(f"{c} string" for c in columns)).csv(path)
                      .select(F.col("_metadata.file_path").alias("file"), F.array(*columns).alias("cells"),
                              F.monotonically_increasing_id().alias("_line")))
    first = cut_lineage(raw.groupBy("file").agg(F.min("_line").alias("first_line")))  # of measured size: lines are not shuffled
    top = raw.join(first, "file").where(F.col("_line") - F.col("first_line") < 3)
    line = lambda nr: F.max_by("cells", F.when(F.col("_line") - F.col("first_line") == nr, F.lit(1)))
    heads = top.groupBy("file", "first_line").agg(line(0).alias("header"), line(1).alias("described"), line(2).alias("measured"))
    missing = ", ".join("'" + t.replace("'", "\\'") + "'" for t in NA_TOKENS)
    text = lambda row: (f"CASE WHEN trim(get({row}, last)) IN ({missing}) THEN NULL ELSE get({row}, last) END")
    heads = (heads.withColumn("names", F.expr("transform(header, h -> lower(trim(h)))"))
             .withColumn("time_at", F.expr("cast(array_position(transform(names, n -> coalesce(contains(n, 'time'), false)), true) - 1 AS int)"))
             .withColumn("time_column", F.expr("get(names, time_at)"))
             .withColumn("at", F.expr(f"""filter(sequence(0, size(names) - 1), i -> get(names, i) IS NOT NULL
                 AND get(names, i) NOT IN ({missing}) AND get(names, i) <> time_column)"""))
             .withColumn("tags", F.expr(f"""transform(transform(array_distinct(transform(at, i -> get(names, i))),
                 n -> struct(n AS name, filter(at, i -> get(names, i) = n) AS places)), t -> struct(t.name AS name, t.places AS places,
                 transform(slice(t.places, -1, 1), last -> {text('described')})[0] AS description,
                 transform(slice(t.places, -1, 1), last -> {text('measured')})[0] AS unit))""")))
    heads = cut_lineage(heads.select("file", "first_line", "time_column", "time_at", "tags"))
    # Fixed value: the reason text
    rejected = heads.where("time_at < 0").select("file", F.lit("No timestamp column found in the data.").alias("reason"))
    heads = heads.where("time_at >= 0")
    filled = lambda t: F.filter(F.transform(t["places"], lambda p: na_to_null(F.get("cells", p))), lambda c: c.isNotNull())
    data = (raw.join(heads, "file").where(F.col("_line") >= F.col("first_line") + 3)
            .select("file", "_line", F.get("cells", F.col("time_at")).alias("ts_text"), F.col("tags.name").alias("names"),
                    F.transform("tags", lambda t: F.get(filled(t), F.lit(0))).alias("cells")))
    return Sheets(heads, data, rejected)


def read_csv_records(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Plain CSV with a header line."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)


def read_xml_records(spark: SparkSession, path: str, row_tag: str = "record", schema=None) -> DataFrame:
    """XML records under ``root/record`` (S5), Spark's built-in XML source."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_json_records(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """JSON records (S6): a JSON array of objects per file (``multi_line=True``, the
    upload format) or one object per line (``multi_line=False``, splittable)."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)
