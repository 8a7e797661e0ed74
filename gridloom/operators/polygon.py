"""Rings and basins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed(ring: Column) -> Column:
    """A ring (ARRAY<STRUCT<x, y>>) whose last point is its first."""
    return F.when((F.size(ring) > 0) & (F.get(ring, F.lit(0)) != F.get(ring, F.size(ring) - 1)), F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))).otherwise(ring)


def parts(points: Column, starts: Column) -> Column:
    """The stretches of a point array that begin at ``starts`` (from 0)."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(points)))
    return F.zip_with(starts, ends, lambda a, b: F.slice(points, a + 1, b - a))


def rounded(ring: Column) -> Column:
    """whole coordinates, halves to even."""
    return F.transform(ring, lambda p: F.struct(F.rint(p["x"]).cast("int").alias("x"), F.rint(p["y"]).cast("int").alias("y")))


def measures(ring: Column) -> Column:
    """STRUCT<area, cx, cy>: signed area (counter-clockwise positive) and centroid, unrounded; area 0 and no
    centroid for a ring of fewer than four closed points or no area. Within the row, no shuffle."""
    r = closed(ring)
    n = F.size(r)
    pairs = F.zip_with(F.slice(r, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(
        (a["x"] * b["y"] - b["x"] * a["y"]).cast("double").alias("c"), (a["x"] + b["x"]).cast("double").alias("sx"), (a["y"] + b["y"]).cast("double").alias("sy")))
    zero = F.struct(*(F.lit(0.0).alias(k) for k in "cxy"))
    t = F.aggregate(pairs, zero, lambda s, p: F.struct((s["c"] + p["c"]).alias("c"), (s["x"] + p["sx"] * p["c"]).alias("x"), (s["y"] + p["sy"] * p["c"]).alias("y")))
    ok = (n >= 4) & (F.abs(t["c"] / 2) >= 1e-9)
    return F.struct(F.when(ok, t["c"] / 2).otherwise(0.0).alias("area"), F.when(ok, F.try_divide(t["x"], 3 * t["c"])).alias("cx"), F.when(ok, F.try_divide(t["y"], 3 * t["c"])).alias("cy"))


def basins(rings: DataFrame, key: str, ring: str) -> DataFrame:
    """Per basin the area of all rings and its label point: the centroid of the largest ring (the first of
    equals), else the mean of all points. ``rings``: (key, part, ring)."""
    m = rings.select(key, "part", F.col(ring).alias("r"), measures(F.col(ring)).alias("m"))
    px = lambda c: F.aggregate("r", F.lit(0.0), lambda s, p: s + p[c])
    out = m.groupBy(key).agg(
        F.sum(F.abs("m.area")).alias("area"),
        F.max_by(F.col("m"), F.struct(F.abs("m.area").alias("a"), (-F.col("part")).alias("p"))).alias("big"),
        F.sum(px("x")).alias("sx"), F.sum(px("y")).alias("sy"), F.sum(F.size("r")).alias("n"))
    at = lambda c, s: F.coalesce(F.col(f"big.{c}"), F.try_divide(F.col(s), F.col("n")))
    return out.select(key, "area", at("cx", "sx").alias("label_x"), at("cy", "sy").alias("label_y"))
