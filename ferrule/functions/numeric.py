"""Measurement values are stored as text; these expressions extract numbers.

The strict rule matches the stored-value contract: a value is numeric only
when it is an unsigned decimal (``1``, ``1.5``, ``0``).  ``-1``, ``1e3``,
``.5`` and ``NaN`` are *not* numeric and become NULL, yet still count as
samples in ``COUNT(*)``.  ``signed`` additionally accepts a leading minus.
Never a bare ``cast``: Spark 4 runs in ANSI mode and would fail the query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numeric-text patterns.
STRICT_NUMERIC_PATTERN = r"^[0-9]+(\.[0-9]+)?$"
SIGNED_NUMERIC_PATTERN = r"^-?[0-9]+(\.[0-9]+)?$"

_PATTERNS = {"strict": STRICT_NUMERIC_PATTERN, "signed": SIGNED_NUMERIC_PATTERN}


def numeric_value(value: Column | str, mode: str = "strict") -> Column:
    """DOUBLE for numeric text, NULL otherwise."""
    col = F.col(value) if isinstance(value, str) else value
    pattern = _PATTERNS[mode]
    return F.when(col.rlike(pattern), col.try_cast("double"))


def is_numeric(value: Column | str, mode: str = "strict") -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.coalesce(col.rlike(_PATTERNS[mode]), F.lit(False))


# Exact-sum type for averages (28 integer digits, 10 decimals).
EXACT_DECIMAL = "decimal(38,10)"


def numeric_decimal(value: Column | str, mode: str = "strict") -> Column:
    """Numeric text as an exact decimal (NULL when not numeric or out of range)."""
    col = F.col(value) if isinstance(value, str) else value
    return F.when(col.rlike(_PATTERNS[mode]), col.try_cast(EXACT_DECIMAL))


def exact_avg(value: Column | str, mode: str = "strict") -> Column:
    """Average of the numeric readings (aggregate expression).

    The digits up to ten decimals are summed as an exact decimal, so the sum of ordinary readings
    does not depend on partitioning or retries; what a reading has beyond that type (more decimals,
    larger magnitudes) is summed as a double remainder and added, so no digit is dropped.  For
    readings that fit the type the remainder is exactly zero.  A decimal sum beyond 28 integer
    digits is the plain double average."""
    num = numeric_value(value, mode)
    dec = numeric_decimal(value, mode)
    total = F.try_sum(dec).cast("double")
    rest = F.sum(num - F.coalesce(dec.cast("double"), F.lit(0.0)))
    exact = (F.coalesce(total, F.lit(0.0)) + rest) / F.count(num)
    return F.when(total.isNotNull() | (F.count(dec) == 0), exact).otherwise(F.avg(num))
