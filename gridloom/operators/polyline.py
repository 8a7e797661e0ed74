"""Polylines as ordered rows or arrays of points, and what is computed along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import turn_angle


def along(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def segments(points: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Consecutive points as (v0, v1) for each value; terminal_flag marks a line's last segment."""
    w = along(key, order)
    nxt = points.select(key, order, *(F.col(v).alias(f"{v}0") for v in values), *(F.lead(v).over(w).alias(f"{v}1") for v in values),
                        F.lead(order).over(w).alias("n1_"), F.lead(order, 2).over(w).alias("n2_"))
    return nxt.where("n1_ is not null").withColumn("terminal_flag", F.col("n2_").isNull().cast("int")).drop("n1_", "n2_")


def array_segments(lines: DataFrame, points: str) -> DataFrame:
    """W2 for lines whose points are one array: no shuffle."""
    p = F.col(points)
    pairs = F.arrays_zip(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))).alias("a"), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))).alias("b"))
    out = lines.select(*(c for c in lines.columns if c != points), F.size(p).alias("n_"), F.posexplode(pairs).alias("i", "s"))
    return out.select(*(c for c in lines.columns if c != points), "i", F.col("s.a").alias("a"), F.col("s.b").alias("b"), (F.col("i") == F.col("n_") - 2).cast("int").alias("terminal_flag"))


def exclusive_sum(df: DataFrame, order: str, size: str, out: str, block: int = 1 << 16, levels: int = 2) -> DataFrame:
    """The sum of ``size`` over all earlier rows. ``order`` is unique.

    Rows are summed by blocks of ``order`` and these by blocks of blocks; windows run within a block, and only the
    topmost sums, one for block ** levels of ``order``, meet in one task.
    """
    past = Window.rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        return df.withColumn(out, F.coalesce(F.sum(size).over(past.orderBy(order)), F.lit(0)))
    b, total, base, own = (f"{c}{levels}_" for c in ("b", "t", "base", "in"))
    at = F.floor(F.col(order) / block)
    totals = exclusive_sum(df.groupBy(at.alias(b)).agg(F.sum(size).alias(total)), b, total, base, block, levels - 1).select(b, base)
    inner = F.coalesce(F.sum(size).over(past.partitionBy(b).orderBy(order)), F.lit(0))
    return df.withColumn(b, at).withColumn(own, inner).join(totals, b).withColumn(out, F.col(base) + F.col(own)).drop(b, own, base)


def line_ordinal(segs: DataFrame, order: str = "seg_id") -> DataFrame:
    """Which line a stored segment is of: the terminal flags before it."""
    return exclusive_sum(segs, order, "terminal_flag", "line_ordinal")


def boundaries(buckets: DataFrame, order: str, count: str) -> DataFrame:
    """[low, high) of the ordinals of each bucket, in order."""
    return exclusive_sum(buckets, order, count, "low").withColumn("high", F.col("low") + F.col(count))


def bucket_of(lines: DataFrame, ordinal: str, bounds: DataFrame) -> DataFrame:
    """Lines with the bucket whose range has their ordinal; the buckets are a small table."""
    return lines.join(F.broadcast(bounds), (F.col(ordinal) >= F.col("low")) & (F.col(ordinal) < F.col("high")), "left")


def revisits(points: DataFrame, key: str, order: str, state: Column, back: int = 6) -> DataFrame:
    """Whether a point's state is among those of the ``back`` points before it."""
    w = along(key, order).rowsBetween(-back, -1)
    return points.withColumn("state_", state).withColumn("revisit", F.coalesce(F.array_contains(F.collect_list("state_").over(w), F.col("state_")), F.lit(False))).drop("state_")


def reversals(points: DataFrame, key: str, order: str, degrees: float = 150.0, within: int = 5) -> DataFrame:
    """The turn at each point, and whether it is the second sharp one within ``within`` steps."""
    w = along(key, order)
    x, y = F.col("x"), F.col("y")
    turn = turn_angle(F.lag("x").over(w), F.lag("y").over(w), x, y, F.lead("x").over(w), F.lead("y").over(w))
    sharp = points.withColumn("turn", turn).withColumn("sharp_", (F.coalesce("turn", F.lit(0.0)) >= degrees).cast("int"))
    return sharp.withColumn("reversal", (F.col("sharp_") == 1) & (F.coalesce(F.sum("sharp_").over(w.rowsBetween(-within, -1)), F.lit(0)) > 0)).drop("sharp_")


def net_displacement(points: DataFrame, key: str, order: str) -> DataFrame:
    """First to last point, length, points and distinct cells of each line."""
    first, last = (f(F.struct("x", "y"), order) for f in (F.min_by, F.max_by))
    return (points.groupBy(key).agg(first.alias("a"), last.alias("b"), F.count("*").alias("points"), F.countDistinct(F.rint("y"), F.rint("x")).alias("unique_xy_cells"))
            .select(key, "points", "unique_xy_cells", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("displacement")))


def bucket_totals(lines: DataFrame, bucket: str, segs: str) -> DataFrame:
    """A24."""
    return lines.groupBy(bucket).agg(F.count("*").alias("streamlines"), F.sum(segs).alias("segments"))


def timeline(scenes: DataFrame, order: str, duration: str, voiced: Column) -> DataFrame:
    """When each scene starts, and the number of those with a voice, counted in order; else NULL."""
    out = exclusive_sum(scenes, order, duration, "start")
    out = exclusive_sum(out.withColumn("v_", voiced.cast("int")), order, "v_", "n_")
    return out.withColumn("voice_number", F.when(F.col("v_") == 1, F.col("n_") + 1)).drop("v_", "n_")


def latest_before(events: DataFrame, steps: DataFrame, key: str, t: str, values: list[str]) -> DataFrame:
    """Each event with the values of the last step at or before its time: one union, one window by key."""
    both = events.select(key, t, F.lit(1).alias("e_"), F.struct(*(F.col(c) for c in events.columns)).alias("ev"), F.lit(None).cast(F_struct(steps, values)).alias("st")).unionByName(
        steps.select(key, t, F.lit(0).alias("e_"), F.lit(None).cast(events.select(F.struct(*events.columns).alias("x")).schema["x"].dataType).alias("ev"), F.struct(*values).alias("st")))
    w = Window.partitionBy(key).orderBy(t, "e_").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("st", F.last("st", True).over(w)).where("e_ = 1").select("ev.*", *(F.col(f"st.{v}").alias(v) for v in values))


def F_struct(df: DataFrame, values: list[str]):
    return df.select(F.struct(*values).alias("x")).schema["x"].dataType


def layer_of(bucket: Column) -> Column:
    """The depth layer that a bucket's name ends in; NULL for none."""
    return F.nullif(F.regexp_extract(bucket, "(surface|upper|mid|lower)$", 1), F.lit(""))


def layers_used(buckets: DataFrame, key: str, count: str) -> DataFrame:
    """One row: whether every bucket that has lines names a layer, so that layers may be split."""
    return buckets.where(F.col(count) > 0).agg(F.coalesce(F.bool_and(layer_of(F.col(key)).isNotNull()), F.lit(False)).alias("split"))
