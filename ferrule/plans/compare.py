"""Order-insensitive result comparison used by the oracle harness and tests."""

from __future__ import annotations

import hashlib
import math

import pandas as pd


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def digest(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:12], rows


def close(a: pd.DataFrame, b: pd.DataFrame, tol: float = 1.5e-6) -> bool:
    """Equal up to float noise: rows aligned on the non-float columns."""
    cols = sorted(a.columns)
    keys = [c for c in cols if a[c].dtype.kind not in "fc"]
    a = a[cols].sort_values(keys, kind="stable").reset_index(drop=True) if keys else a[cols]
    b = b[cols].sort_values(keys, kind="stable").reset_index(drop=True) if keys else b[cols]
    for c in cols:
        if a[c].dtype.kind in "fc" or b[c].dtype.kind in "fc":
            x, y = a[c].astype(float), b[c].astype(float)
            if not (((x - y).abs() <= tol) | (x.isna() & y.isna())).all():
                return False
        elif not a[c].astype(str).equals(b[c].astype(str)):
            return False
    return True


def same_result(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> bool:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns) or len(spark_pdf) != len(oracle_pdf):
        return False
    if digest(spark_pdf)[0] == digest(oracle_pdf)[0]:
        return True
    return close(spark_pdf, oracle_pdf)
