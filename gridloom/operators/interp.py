"""Interpolation in depth profiles and on grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(depths: Column, values: Column, t: Column, right: bool = False) -> Column:
    """J6 (``right`` False), J7 (True): linear interpolation in a profile, arrays sorted by depth.

    J6 brackets with the knot below a depth that is exactly a knot, J7 with the one above. NULL outside the
    profile, for an empty one, or if an end of the bracket is missing; J7 wants the whole profile there. A gap of
    1e-6 or less gives the lower value.
    """
    n = F.size(depths)
    count = F.size(F.filter(depths, lambda d: (d <= t) if right else (d < t)))
    upper = F.least(F.greatest(count, F.lit(1)), n - 1)
    d0, d1 = F.get(depths, upper - 1), F.get(depths, upper)
    v0, v1 = F.get(values, upper - 1), F.get(values, upper)
    gap = d1 - d0
    inner = F.when(F.abs(gap) <= 1e-6, v0).otherwise(v0 + (v1 - v0) * F.try_divide(t - d0, gap))
    ok = (n > 1) & (t >= F.get(depths, F.lit(0))) & (t <= F.get(depths, n - 1))
    if right:
        ok &= ~F.exists(values, lambda v: v.isNull()) & ~F.exists(depths, lambda d: d.isNull())
        inner = F.when(t == F.get(depths, n - 1), F.get(values, n - 1)).otherwise(inner)
    else:
        inner = F.when(v1.isNotNull() & v0.isNotNull(), inner)
    return F.when(ok, inner)


def depth_bracket(axis: list[float], t: Column) -> tuple[Column, Column, Column]:
    """(lower, upper, fraction) of a depth on a fixed axis; NULL outside."""
    a = F.array(*map(F.lit, axis))
    n = len(axis)
    upper = F.least(F.greatest(F.size(F.filter(a, lambda d: d <= t)), F.lit(1)), F.lit(n - 1))
    lower = upper - 1
    ok = t.between(axis[0], axis[-1])
    gap = F.get(a, upper) - F.get(a, lower)
    return F.when(ok, lower), F.when(ok, upper), F.when(ok, F.when(gap > 1e-6, F.try_divide(t - F.get(a, lower), gap)).otherwise(0.0))


def corners(points: DataFrame, nx: int, ny: int, strict: bool = False) -> DataFrame:
    """Each point (fc, fr: grid coordinates) with its four cells: row, col, w. Points outside give none; with
    ``strict`` those on the far edge neither."""
    fc, fr = F.col("fc"), F.col("fr")
    high = (fc < nx - 1) & (fr < ny - 1) if strict else (fc <= nx - 1) & (fr <= ny - 1)
    c0, r0 = F.floor(fc), F.floor(fr)
    tc, tr = fc - c0, fr - r0
    four = F.array(*(
        F.struct(F.least(r0 + dr, F.lit(ny - 1)).alias("row"), F.least(c0 + dc, F.lit(nx - 1)).alias("col"),
                 ((tc if dc else 1 - tc) * (tr if dr else 1 - tr)).alias("w")) for dr in (0, 1) for dc in (0, 1)))
    return points.where((fc >= 0) & (fr >= 0) & high).withColumn("corner", F.explode(four)).select(*points.columns, "corner.*")


def bilinear(points: DataFrame, field: DataFrame, value: str, nx: int, ny: int, key: str) -> DataFrame:
    """(key, value): NULL outside the grid or if one of the four cells is missing.

    The four cells of a point are rows, joined once on (row, col) and summed by point.
    """
    got = corners(points.select(key, "fc", "fr"), nx, ny).join(field.select("row", "col", F.col(value).alias("v")), ["row", "col"], "left")
    full = got.groupBy(key).agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.count("v").alias("n"))
    return points.select(key).join(full, key, "left").select(key, F.when(F.col("n") == 4, F.col("s")).alias(value))


def bilinear_mask(points: DataFrame, mask: DataFrame, value: str, nx: int, ny: int, key: str) -> DataFrame:
    """(key, value): whether all four cells are set; false outside and on the far edge."""
    got = corners(points.select(key, "fc", "fr"), nx, ny, strict=True).join(mask.select("row", "col", F.col(value).alias("v")), ["row", "col"], "left")
    full = got.groupBy(key).agg(F.min(F.coalesce("v", F.lit(False))).alias("v"))
    return points.select(key).join(full, key, "left").select(key, F.coalesce("v", F.lit(False)).alias(value))


def trilinear(points: DataFrame, volume: DataFrame, value: str, axis: list[float], nx: int, ny: int, key: str) -> DataFrame:
    """Bilinear at the two levels around each point's depth, then between them. One join, one sum a point.

    ``volume``: (level, row, col, value). A level of weight 0 is not asked for.
    """
    lower, upper, f = depth_bracket(axis, F.col("depth"))
    levels = F.filter(F.array(F.struct(lower.alias("level"), (1 - f).alias("lw")), F.struct(upper.alias("level"), f.alias("lw"))), lambda x: x["lw"] > 1e-9)
    wide = corners(points.select(key, "fc", "fr", "depth").where(lower.isNotNull()), nx, ny).withColumn("l", F.explode(levels)).select(key, "row", "col", "l.level", (F.col("w") * F.col("l.lw")).alias("w"))
    got = wide.join(volume.select("level", "row", "col", F.col(value).alias("v")), ["level", "row", "col"], "left")
    full = got.groupBy(key).agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.count("v").alias("n"), F.count("*").alias("of"))
    return points.select(key).join(full, key, "left").select(key, F.when(F.col("n") == F.col("of"), F.col("s")).alias(value))
