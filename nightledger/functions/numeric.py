"""Numeric column helpers: missing values, clipping and decimal rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN becomes NULL: in this engine NULL alone means "not measured"."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """NULL for NaN and for both infinities."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def nonzero(x: Column) -> Column:
    """NULL for zero, used where a stored 0 means "unknown"."""
    return F.when(x != 0, x)


def floor_mod(a: Column, b: Column | float) -> Column:
    """Modulo whose sign follows the divisor."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return a - b * F.floor(a / b)


def py_round(x: Column, digits: int) -> Column:
    """Round half to even on the *binary* value, with `digits` (0-8) decimals.

    Spark's bround looks at the shortest decimal text, so 2.45 (stored as
    2.4500000000000001776) would go to 2.4; the exact value lies above the
    tie.  Where the product x * 10**digits looks like a tie, its rounding
    error decides.  The error is exact: the float half of x and the rest each
    multiply without rounding.
    """
    if digits == 0:
        return F.rint(x)
    scale = float(10 ** digits)
    s = F.lit(scale)
    p = x * s
    half = x.cast("float").cast("double")
    err = (half * s - p) + (x - half) * s
    nudge = F.when(p - F.floor(p) == 0.5, F.signum(err) * 0.25).otherwise(F.lit(0.0))
    return F.rint(p + nudge) / s
