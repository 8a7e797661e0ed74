"""A field resampled to a target grid, quantised, and summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validity import paired_sentinel, quantize
from ..operators import grid, stats


def velocity(spark: SparkSession, target: grid.Grid, source: grid.Grid, field: DataFrame, fill: float = -99999.9, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(cells, summary): vx, vy of the nearest source cells as 16-bit numbers, and the speed's summary."""
    got = grid.resample_nearest(grid.cells(spark, target), source, field, ["vx", "vy"])
    vx, vy = paired_sentinel(F.col("vx"), F.col("vy"), fill)
    ok = got.withColumns({"vx": vx, "vy": vy}).withColumn("speed", F.hypot("vx", "vy"))
    cells = ok.select("cell_id", "row", "col", quantize(F.col("vx"), scale).alias("vx"), quantize(F.col("vy"), scale).alias("vy"))
    v = F.col("speed")
    return cells, ok.agg(*stats.coverage(v), *stats.stats(v), *stats.quantiles(v))


def scalar(spark: SparkSession, target: grid.Grid, source: grid.Grid, field: DataFrame, value: str, valid, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(cells, summary) of one field under a rule of ``functions.validity``."""
    got = grid.resample_nearest(grid.cells(spark, target), source, field, [value]).withColumn(value, valid(F.col(value)))
    v = F.col(value)
    cells = got.select("cell_id", "row", "col", quantize(v, scale).alias(value))
    return cells, got.agg(*stats.coverage(v), *stats.stats(v), *stats.quantiles(v, stats.QUANTILES | {"q99_5": 0.995}))
