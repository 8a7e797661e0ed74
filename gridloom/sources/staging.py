"""Scans of staged science products: Parquet or JSON tables of (row, col, level, ...) and of polygon records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validity import not_huge
from ..operators.grid import strided


def masked(df: DataFrame, *columns: str) -> DataFrame:
    """Variables with their missing, infinite and huge values as NULL."""
    return df.withColumns({c: not_huge(F.col(c)) for c in columns})


def levels(volume: DataFrame, time: int = 0, columns: tuple[str, ...] = ("u", "v", "w", "temp", "salt")) -> DataFrame:
    """One instant of a volume, all levels; the filter reaches the scan."""
    at = volume.where(F.col("time") == time).drop("time") if "time" in volume.columns else volume
    return masked(at, *(c for c in columns if c in volume.columns))


def sparse_volume(volume: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column of each level."""
    return strided(volume, step)


def attributes(df: DataFrame, defaults: dict[str, Column | str | float]) -> DataFrame:
    """Attributes of a product with defaults for what is absent; unknown names are added."""
    return df.select(*(c for c in df.columns if c not in defaults), *(
        (F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v)).alias(k) for k, v in defaults.items()))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, part, ring) of staged polygon records {subregion, name, points [{x, y}], starts}; records
    without a sub-region, and parts of fewer than two points, are left out."""
    from ..functions.text import region_name
    from ..operators.polygon import parts

    raw = spark.read.json(path)
    sub = F.trim("subregion")
    pieces = raw.where(sub != "").select(sub.alias("id"), region_name(F.col("name"), sub).alias("name"), F.posexplode(parts(F.col("points"), F.col("starts").cast("array<int>"))).alias("part", "ring"))
    return pieces.where(F.size("ring") >= 2)
