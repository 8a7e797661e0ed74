"""Summaries over valid values. All are declarative aggregates: partial on the map side, merged after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = {"median": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99}


def stats(v: Column, empty: float | None = None) -> list[Column]:
    """A1, A2: min, max, mean of a column whose missing values are NULL; ``empty`` for no values, else NULL."""
    put = (lambda c: c) if empty is None else (lambda c: F.coalesce(c, F.lit(float(empty))))
    return [put(F.min(v)).alias("min"), put(F.max(v)).alias("max"), put(F.avg(v)).alias("mean")]


def quantiles(v: Column, of: dict[str, float] = QUANTILES) -> list[Column]:
    """A3: exact quantiles with linear interpolation."""
    return [F.percentile(v, F.lit(q)).alias(name) for name, q in of.items()]


def percentile_range(v: Column, low: float, high: float) -> list[Column]:
    """A4: two percentiles; the extremes if they don't open a range, 0 and 1 for no values."""
    a, b = F.percentile(v, F.lit(low / 100)), F.percentile(v, F.lit(high / 100))
    ok = b > a
    return [F.coalesce(F.when(ok, a).otherwise(F.min(v)), F.lit(0.0)).alias("low"), F.coalesce(F.when(ok, b).otherwise(F.max(v)), F.lit(1.0)).alias("high")]


def coverage(v: Column) -> list[Column]:
    """A6."""
    return [F.count(v).alias("valid_count"), F.count(F.lit(1)).alias("cell_count"), (F.count(v) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("fraction")]


def category_counts(df: DataFrame, key: str) -> DataFrame:
    """One MAP of category to rows."""
    return df.groupBy(F.col(key).cast("string").alias("k")).count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "count")))).alias("counts"))


def merged_stats(parts: DataFrame, weight: str, by: list[str] | None = None) -> DataFrame:
    """Summaries of parts (min, max, mean, weight) as one; parts with a missing member are left out and
    none at all give zeros. Associative, so parts may be merged in any grouping."""
    ok = F.lit(True)
    for c in ("min", "max", "mean"):
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    on = lambda c: F.when(ok, c)
    w = F.sum(on(F.col(weight)))
    mean = F.try_divide(F.sum(on(F.col("mean") * F.col(weight))), w)
    return parts.groupBy(*by or ()).agg(*(F.coalesce(c, F.lit(0.0)).alias(n) for c, n in ((F.min(on(F.col("min"))), "min"), (F.max(on(F.col("max"))), "max"), (mean, "mean"))), F.coalesce(w, F.lit(0)).alias(weight))


def merged_counts(parts: DataFrame, counts: str) -> DataFrame:
    """(key, count): maps of counts added up."""
    return parts.select(F.explode(counts).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("count"))


def merged_arrays(parts: DataFrame, counts: str, length: int = 8) -> DataFrame:
    """(position, count): arrays of counts added up by position, as far as ``length``."""
    return parts.select(F.posexplode(counts).alias("position", "n")).where(F.col("position") < length).groupBy("position").agg(F.sum("n").alias("count"))


def weighted_mean(v: Column, weight: Column) -> Column:
    """A missing value adds nothing above the line, but its weight stays below it."""
    return F.try_divide(F.sum(F.coalesce(v, F.lit(0.0)) * weight), F.sum(weight))


def display_range(v: Column, mode: str, low: float, high: float) -> list[Column]:
    """The range of a colour scale by its mode; low and high are percentiles. Limits are fixed values."""
    if mode == "zero_centered_asymmetric":
        a = F.percentile(F.when(v < 0, v), F.lit(max(0.0, 100 - low) / 100))
        b = F.percentile(F.when(v > 0, v), F.lit(min(100.0, high) / 100))
        out = F.least(F.coalesce(a, F.lit(-0.25)), F.lit(-0.05)), F.greatest(F.coalesce(b, F.lit(0.25)), F.lit(0.25))
    else:
        a, b = F.percentile(v, F.lit(low / 100)), F.percentile(v, F.lit(high / 100))
        if mode == "sequential_positive":
            out = F.least(F.lit(0.0), a), F.greatest(b, F.least(F.lit(0.0), a) + 1e-6)
        elif mode == "negative_depth":
            out = a, F.lit(0.0)
        else:
            raise ValueError(f"no such display mode: {mode}")
    return [out[0].alias("low"), out[1].alias("high")]


def bounds(*columns: str) -> list[Column]:
    """Least and greatest value over several columns."""
    return [F.least(*(F.min(c) for c in columns)).alias("low"), F.greatest(*(F.max(c) for c in columns)).alias("high")] if len(columns) > 1 else [F.min(columns[0]).alias("low"), F.max(columns[0]).alias("high")]


def sampled_median(df: DataFrame, order: str, value: str, cap: int = 180_000) -> DataFrame:
    """The median over each n-th row in order, n such that ``cap`` rows stay (the cap is the operator's own).

    ``order`` is a dense index from 0, so no global numbering is needed.
    """
    n = F.greatest(F.lit(1), F.ceil(F.lit(df.count()) / cap).cast("long"))
    return df.where(F.col(order) % n == 0).agg(F.percentile(value, F.lit(0.5)).alias("median"))
