"""String expressions for hierarchy labels and icon names (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviation fixes applied in this order after title-casing.
ABBREVIATIONS = (
    ("Kg", "KG"),
    ("Id", "ID"),
    ("Db", "DB"),
    ("Api", "API"),
    ("Ui", "UI"),
    ("Url", "URL"),
    ("Http", "HTTP"),
    ("Https", "HTTPS"),
    ("Json", "JSON"),
    ("Xml", "XML"),
    ("Sql", "SQL"),
)

# Default icon per keyword (first match in this order wins), else "file".
ICON_KEYWORDS = (
    ("equipment", "cog"),
    ("process", "settings"),
    ("vessel", "database"),
    ("mixer", "shuffle"),
    ("splitter", "split"),
    ("column", "bar-chart"),
    ("pump", "zap"),
    ("valve", "toggle-left"),
    ("tank", "droplet"),
    ("reactor", "atom"),
    ("heat", "thermometer"),
    ("cool", "snowflake"),
    ("filter", "filter"),
    ("separator", "layers"),
    ("compressor", "wind"),
    ("turbine", "rotate-cw"),
    ("motor", "power"),
    ("sensor", "activity"),
    ("control", "sliders"),
    ("safety", "shield"),
    ("maintenance", "tool"),
    ("inspection", "search"),
    ("quality", "check-circle"),
    ("production", "play-circle"),
    ("utility", "grid"),
    ("electrical", "zap"),
    ("mechanical", "settings"),
    ("instrumentation", "gauge"),
    ("piping", "git-branch"),
)
DEFAULT_ICON = "file"

CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def title_case(c) -> Column:
    """Word-wise title case where any non-cased character starts a new word
    (``o'neil 3d-pump`` -> ``O'Neil 3D-Pump``); ``initcap`` only splits on spaces."""
    runs = F.regexp_extract_all(_col(c), F.lit(f"([{CASED}]+|[^{CASED}]+)"), 1)
    fixed = F.transform(runs, lambda s: F.when(
        s.rlike(f"^[{CASED}]"), F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))
    ).otherwise(s))
    return F.array_join(fixed, "")


def display_name(component) -> Column:
    """``_``/``-`` become spaces, title case, then the ordered abbreviation fixes."""
    out = title_case(F.translate(_col(component), "_-", "  "))
    for src, dst in ABBREVIATIONS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def default_icon(component) -> Column:
    low = F.lower(_col(component))
    expr = None
    for kw, icon in ICON_KEYWORDS:
        cond = low.contains(kw)
        expr = F.when(cond, F.lit(icon)) if expr is None else expr.when(cond, F.lit(icon))
    return expr.otherwise(F.lit(DEFAULT_ICON))


def clean_icon_name(name) -> Column:
    """Keep letters, digits, ``-`` and ``_``."""
    return F.regexp_replace(_col(name), r"[^\p{L}\p{N}_-]", "")


def icon_short_name(file_name) -> Column:
    """Stored icon file -> short name: drop ``.svg``, then the last ``_<suffix>`` part."""
    return F.regexp_replace(F.replace(_col(file_name), F.lit(".svg"), F.lit("")), r"_[^_]*$", "")
