"""Six rules for what counts as a value, and quantisation to packed integers.

Every rule maps a column to the same column with NULL for what is missing, so that Spark's aggregates skip it.
NaN never passes a rule. Numbers are DOUBLE inside; casts to small types come after clipping, for ANSI casts throw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILL, LIMIT = -32768, 32767


def num(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def finite(v: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def exact_sentinel(v: Column, fill: float | Column = -9999.0) -> Column:
    """V1: finite and not the fill value."""
    return F.when(finite(num(v)) & (num(v) != F.lit(fill)), num(v))


def paired_sentinel(x: Column, y: Column, fill: float | Column = -99999.9, tolerance: float = 1e-3) -> tuple[Column, Column]:
    """V2: both components finite and farther than the tolerance from one shared fill value."""
    ok = finite(num(x)) & finite(num(y)) & (F.abs(num(x) - F.lit(fill)) > tolerance) & (F.abs(num(y) - F.lit(fill)) > tolerance)
    return F.when(ok, num(x)), F.when(ok, num(y))


def non_negative(v: Column) -> Column:
    """V3."""
    return F.when(finite(num(v)) & (num(v) >= 0), num(v))


def positive(v: Column) -> Column:
    """V4."""
    return F.when(finite(num(v)) & (num(v) > 0), num(v))


def mask_gated(v: Column, mask: Column, keep: int = 2) -> Column:
    """V5: only where the mask has the class."""
    return F.when((mask == keep) & finite(num(v)), num(v))


def not_huge(v: Column, limit: float = 1e20) -> Column:
    """V6: finite and no larger than the limit."""
    return F.when(finite(num(v)) & (F.abs(num(v)) <= limit), num(v))


def clip(v: Column, low: float | Column, high: float | Column) -> Column:
    return F.greatest(F.least(v, F.lit(high).cast("double")), F.lit(low).cast("double"))


def quantize(v: Column, scale: float = 1.0, low: float = -LIMIT, high: float = LIMIT, fill: int = FILL) -> Column:
    """Scaled, rounded half to even and clipped to 16 bits; the fill value for NULL and NaN."""
    x = num(v) / F.lit(float(scale))
    return F.when(finite(x), F.rint(clip(x, low, high)).cast("int")).otherwise(F.lit(fill)).cast("smallint")


def dequantize(raw: Column, scale: float = 1.0, offset: float = 0.0, fill: int = FILL) -> Column:
    """NULL for the fill value, else raw * scale + offset."""
    return F.when(raw != fill, raw.cast("double") * F.lit(float(scale)) + F.lit(float(offset)))


def identifier(v: Column) -> Column:
    """Missing to 0, rounded half to even, clipped to 16 unsigned bits."""
    return F.rint(clip(F.when(finite(num(v)), num(v)).otherwise(0.0), 0, 65535)).cast("int")
