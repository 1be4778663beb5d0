"""Icon assets: audit (V1), clean (V2) and inventory (V3) over many files at once.

Input rows are ``(file_name, content BINARY)`` -- e.g. Spark's ``binaryFile``
source over an icon folder.  Size, extension and substring rules are column
expressions; only XML well-formedness and the element clean-up need a parser,
so they run in Arrow-batched pandas UDFs (one parser call per file, no
per-row JVM round trip).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Size cap, element and attribute deny lists, added namespace and header.
MAX_SVG_BYTES = 1024 * 1024
DANGEROUS_ELEMENTS = ("script", "object", "embed", "iframe", "link")
DANGEROUS_ATTRIBUTES = ("onload", "onclick", "onmouseover", "onerror")
SVG_NAMESPACE = "http://www.w3.org/2000/svg"
XML_HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n'


def read_icon_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``file_name, file_path, content, file_size`` for every file in a folder."""
    raw = spark.read.format("binaryFile").load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("path").alias("file_path"),
                      "content", F.col("length").alias("file_size"))


@pandas_udf(StringType())
def _xml_error(content: pd.Series) -> pd.Series:
    """NULL when the bytes are UTF-8 text that parses as XML, else the reason."""
    import xml.etree.ElementTree as ET

    out = []
    for b in content:
        if b is None:
            out.append("Error validating file: no content")
            continue
        try:
            text = bytes(b).decode("utf-8")
        except UnicodeDecodeError:
            out.append("File encoding not supported (use UTF-8)")
            continue
        try:
            ET.fromstring(text)
            out.append(None)
        except ET.ParseError as e:
            out.append(f"Invalid XML/SVG format: {e}")
    return pd.Series(out, dtype=object)


def audit_svg(files: DataFrame, name_col: str = "file_name", content_col: str = "content") -> DataFrame:
    """V1: ``is_valid`` and ``error`` per file, rules applied in order: extension, size,
    encoding + XML, ``<svg`` present, no dangerous element."""
    size = F.octet_length(F.col(content_col))
    # a binary -> string cast never fails on malformed UTF-8 (decode would raise under ANSI)
    text = F.lower(F.col(content_col).cast("string"))
    # only files that pass the cheap rules are shipped to the parser: the others' input is NULL
    gate = F.lower(F.col(name_col)).endswith(".svg") & (size <= MAX_SVG_BYTES)
    gated = F.when(gate, _xml_error(F.when(gate, F.col(content_col))))
    # The messages.
    err = (F.when(~F.lower(F.col(name_col)).endswith(".svg"), F.lit("File must be an SVG file (.svg)"))
           .when(size > MAX_SVG_BYTES, F.lit("SVG file too large (max 1MB)"))
           .when(F.col("_xml_err").isNotNull(), F.col("_xml_err"))
           .when(~text.contains("<svg"), F.lit("File does not contain valid SVG content")))
    for el in DANGEROUS_ELEMENTS:
        err = err.when(text.contains(f"<{el}"), F.lit(f"SVG contains potentially dangerous element: {el}"))
    out = files.withColumn("_xml_err", gated).withColumn("error", err)
    return (out.withColumn("is_valid", F.col("error").isNull())
            .withColumn("file_size", size.cast("bigint"))
            .withColumn("content_length", F.when(F.col("is_valid"), F.length(F.col(content_col).cast("string"))))
            .drop("_xml_err"))


class _SafeSvg:
    """Parser target that writes a document out again while it is read, without what a deny list names: a denied
    element is written empty (whatever stands inside it is skipped, what follows it is kept), and so are
    attributes whose name holds a denied one."""

    def __init__(self):
        from io import StringIO
        from xml.sax.saxutils import XMLGenerator

        self.text = StringIO()
        self.out = XMLGenerator(self.text, short_empty_elements=True)
        self.skipping = 0
        self.top = True
        self.prefixes: list = []

    @staticmethod
    def denied(name: str) -> bool:
        return name.rpartition(":")[2].lower() in DANGEROUS_ELEMENTS

    def start(self, name, attributes):
        if not self.skipping:
            safe = {k: v for k, v in attributes.items()
                    if not any(x in k.lower() for x in DANGEROUS_ATTRIBUTES)} if not self.denied(name) else {}
            if self.top and ":" not in name:
                safe.setdefault("xmlns", SVG_NAMESPACE)
            self.top = False
            self.out.startElement(name, safe)
        if self.skipping or self.denied(name):
            self.skipping += 1

    def end(self, name):
        self.skipping = max(0, self.skipping - 1)
        if not self.skipping:
            self.out.endElement(name)

    def data(self, text):
        if not self.skipping:
            self.out.characters(text)


def safe_svg(text: str) -> str:
    """``text`` without denied elements' content and attributes, with namespace and XML header; text that does not
    parse stays as it is."""
    from xml.parsers import expat

    target = _SafeSvg()
    reader = expat.ParserCreate()
    reader.StartElementHandler, reader.EndElementHandler = target.start, target.end
    reader.CharacterDataHandler, reader.buffer_text = target.data, True
    try:
        reader.Parse(text, True)
    except expat.ExpatError:
        return text
    target.out.endDocument()  # flushes
    return XML_HEADER + target.text.getvalue()


@pandas_udf(StringType())
def _safe_svg(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else safe_svg(bytes(b).decode("utf-8", errors="replace")))


def clean_svg(audited: DataFrame, content_col: str = "content") -> DataFrame:
    """V2: cleaned text for valid files (denied elements emptied, event attributes dropped, namespace and XML header
    added; the original is kept if it does not parse).  Names are compared without their prefix, so
    namespaced scripts are caught too.  Only valid files' bytes go to the parser."""
    return audited.withColumn("clean_svg", _safe_svg(F.when(F.col("is_valid"), F.col(content_col))))


def icon_inventory(files: DataFrame, name_col: str = "file_name", content_col: str = "content") -> DataFrame:
    """V3: ``icon_name, file_name, file_size, svg_base64`` for ``.svg`` files."""
    from ferrule.functions.text import icon_short_name

    svg = files.filter(F.col(name_col).endswith(".svg"))
    return svg.select(icon_short_name(F.col(name_col)).alias("icon_name"), F.col(name_col).alias("file_name"),
                      F.octet_length(content_col).cast("bigint").alias("file_size"),
                      # one-line base64 (the built-in may wrap MIME-style every 76 characters)
                      F.translate(F.base64(F.col(content_col)), "\r\n", "").alias("svg_base64"))
