"""Time-bucket expressions, interval strings and timestamp parsing.

Buckets follow the time-series convention: fixed-length intervals (seconds to
weeks) are aligned to Monday 2000-01-03 00:00, month-based intervals to
2000-01-01.  Everything is integer arithmetic on TIMESTAMP_NTZ, so it stays
inside whole-stage codegen and never depends on the session time zone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket origins and unit lengths.
FIXED_ORIGIN = "2000-01-03 00:00:00"
MONTH_ORIGIN_YEAR = 2000
MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
TRUNC_UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")

_INTERVAL_RE = re.compile(r"^\s*(\d+)?\s*([a-zA-Z]+?)s?\s*$")


class IntervalError(ValueError):
    pass


@dataclass(frozen=True)
class Interval:
    """A parsed bucket width: either fixed micros or a whole number of months."""

    count: int
    unit: str

    @property
    def is_monthly(self) -> bool:
        return self.unit in MONTHS

    @property
    def micros(self) -> int:
        if self.is_monthly:
            raise IntervalError(f"{self} has no fixed length")
        return self.count * MICROS[self.unit]

    @property
    def months(self) -> int:
        return self.count * MONTHS[self.unit]

    def sql(self) -> str:
        return f"{self.count} {self.unit}{'s' if self.count != 1 else ''}"


def parse_interval(text: str | Interval) -> Interval:
    """``'1 hour'``, ``'15 minutes'``, ``'3 months'``, ``'day'`` -> Interval (allow-listed units)."""
    if isinstance(text, Interval):
        return text
    m = _INTERVAL_RE.match(str(text).lower())
    if not m:
        raise IntervalError(f"unparseable interval {text!r}")
    count = int(m.group(1) or 1)
    unit = m.group(2)
    if unit.endswith("s") and unit[:-1] in MICROS.keys() | MONTHS.keys():
        unit = unit[:-1]
    if unit not in MICROS and unit not in MONTHS:
        raise IntervalError(f"unsupported interval unit {unit!r}")
    if count <= 0:
        raise IntervalError("interval must be positive")
    return Interval(count, unit)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_bucket(interval: str | Interval, ts: Column | str) -> Column:
    """Start of the bucket holding ``ts`` (TIMESTAMP_NTZ)."""
    iv = parse_interval(interval)
    ts = _col(ts)
    if iv.is_monthly:
        n = iv.months
        month_index = (F.year(ts) - MONTH_ORIGIN_YEAR) * 12 + F.month(ts) - 1
        start_index = month_index - F.pmod(month_index, F.lit(n))
        return F.make_timestamp_ntz(
            F.lit(MONTH_ORIGIN_YEAR) + F.floor(start_index / 12).cast("int"),
            F.pmod(start_index, F.lit(12)).cast("int") + 1,
            F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    width = iv.micros
    origin = F.lit(FIXED_ORIGIN).cast("timestamp_ntz")
    offset = F.timestamp_diff("MICROSECOND", origin, ts)
    return F.timestamp_add("MICROSECOND", offset - F.pmod(offset, F.lit(width)), origin)


def bucket_end(interval: str | Interval, start: Column | str) -> Column:
    """Exclusive end of a bucket starting at ``start``."""
    iv = parse_interval(interval)
    start = _col(start)
    if iv.is_monthly:
        return F.timestamp_add("MONTH", F.lit(iv.months), start)
    return F.timestamp_add("MICROSECOND", F.lit(iv.micros), start)


def date_trunc(unit: str, ts: Column | str) -> Column:
    """Truncation variant (unit names only, as NTZ)."""
    unit = unit.lower().rstrip("s") if unit.lower() not in ("hours",) else "hour"
    if unit not in TRUNC_UNITS:
        raise IntervalError(f"unsupported truncation unit {unit!r}")
    return F.date_trunc(unit, _col(ts)).cast("timestamp_ntz")


# --------------------------------------------------------------------------
# Timestamp text parsing
# --------------------------------------------------------------------------

# Accepted text layouts, tried in this order (ISO, day-first, month-first).
TIMESTAMP_FORMATS = (
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
    "d/M/yyyy H:m:s",
    "d/M/yyyy",
    "M/d/yyyy H:m:s",
    "M/d/yyyy",
)


# The layouts of an uploaded sheet -- ISO, then one order of day and month per file.
ISO_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d")
MONTH_FIRST_FORMATS = ("M/d/yyyy H:m:s", "M/d/yyyy")
DAY_FIRST_FORMATS = ("d/M/yyyy H:m:s", "d/M/yyyy")


def parse_timestamp_text(text: Column | str, formats=TIMESTAMP_FORMATS) -> Column:
    """First format that parses wins; NULL when none does (no exception)."""
    c = F.trim(_col(text))
    attempts = [F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]
    # ISO with a 'T' separator and optional fraction / zone suffix.
    iso = F.regexp_replace(c, r"(Z|[+-]\d\d:?\d\d)$", "")
    attempts.append(F.try_to_timestamp(F.regexp_replace(iso, "T", " ")).cast("timestamp_ntz"))
    return F.coalesce(*attempts)


def normalize_timestamp_text(text: Column | str) -> Column:
    """Parse any accepted layout and render ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(parse_timestamp_text(text), "yyyy-MM-dd HH:mm:ss")


def iso_bound(text: str) -> str:
    """Query bound: ISO-8601 text, a zone suffix is dropped, wall clock kept."""
    s = text.strip().replace("T", " ")
    s = re.sub(r"(Z|[+-]\d\d:?\d\d)$", "", s)
    return s


def iso_format(ts: Column | str) -> Column:
    """Result rendering of timestamps (ISO-8601 with ``T``)."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def ntz(ts) -> Column:
    """A wall-clock literal.  A naive datetime in ``F.lit`` would be an instant of the session zone;
    the text form is the same wall clock in every zone."""
    text = ts.isoformat(sep=" ") if hasattr(ts, "isoformat") else iso_bound(str(ts))
    return F.lit(text).cast("timestamp_ntz")


def bucket_start(interval: str | Interval, ts):
    """Python twin of ``time_bucket`` for literal bounds of fixed-length buckets."""
    import datetime as _dt

    ts = ts if isinstance(ts, _dt.datetime) else _dt.datetime.fromisoformat(str(ts))
    origin = _dt.datetime.fromisoformat(FIXED_ORIGIN)
    width = _dt.timedelta(microseconds=parse_interval(interval).micros)
    return ts - (ts - origin) % width


def minus_interval(ts, interval: str | Interval):
    """Python-side ``ts - interval`` for literal bounds (months clamp to month end)."""
    import calendar
    import datetime as _dt

    iv = parse_interval(interval)
    ts = ts if isinstance(ts, _dt.datetime) else _dt.datetime.fromisoformat(str(ts))
    if not iv.is_monthly:
        return ts - _dt.timedelta(microseconds=iv.micros)
    y, m = divmod(ts.year * 12 + ts.month - 1 - iv.months, 12)
    return ts.replace(year=y, month=m + 1, day=min(ts.day, calendar.monthrange(y, m + 1)[1]))
