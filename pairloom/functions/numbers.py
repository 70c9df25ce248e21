"""Numbers as text, missing values, safe ratios and rounding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean "missing", whatever their case; fixed values.
MISSING = ("", "nan", "na", "n/a", "null", "none")


def finite(x: Column) -> Column:
    """Whether x is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def missing_to_null(cell: Column) -> Column:
    """The cell as a double; null if it means missing or is no number."""
    text = F.trim(cell)
    return F.when(~F.lower(text).isin(*MISSING), F.expr("1D") * text.try_cast("double"))


def float_label(x: Column) -> Column:
    """Whole numbers without a point, infinity as ``inf``, else the shortest decimal."""
    return F.when(F.abs(x) == float("inf"), F.lit("inf")).when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` of 0 or more to so many digits, halves away from 0, as DuckDB's round does it; NaN stays."""
    scaled = x * 10.0**digits
    whole = np.floor(scaled)
    whole += scaled - whole >= 0.5
    whole /= 10.0**digits
    return whole
