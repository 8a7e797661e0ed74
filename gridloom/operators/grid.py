"""Regular grids: axes, nearest-cell resampling, lookups by cell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cell_index, inside

#: Bytes of a lookup side up to which it is broadcast; beyond, Spark shuffles as it sees fit.
SMALL = 10 << 20


@dataclass(frozen=True)
class Grid:
    """Cell centres at x0 + col * dx, y0 + row * dy; dy is usually negative."""

    nx: int
    ny: int
    x0: float
    y0: float
    dx: float
    dy: float

    def __post_init__(self) -> None:
        if self.nx < 1 or self.ny < 1 or not self.dx or not self.dy:
            raise ValueError("a grid needs cells and a step along both axes")


def axis(spark: SparkSession, count: int, start: float, step: float, index: str, value: str) -> DataFrame:
    """(index, coordinate) of an axis."""
    return spark.range(count).select(F.col("id").alias(index), (F.lit(float(start)) + F.col("id") * float(step)).alias(value))


def resolution_axis(spark: SparkSession, count: int, start: float, step: float, resolution: float) -> DataFrame:
    """(i, target, src): an axis at another resolution over the same extent, and each point's nearest source
    index, clipped. An axis needs two points, a step and a positive resolution."""
    if count < 2 or step == 0 or resolution <= 0:
        raise ValueError("an axis needs two points, a step and a positive resolution")
    n = int(abs(step) * (count - 1) // resolution) + 1
    way = resolution if step > 0 else -resolution
    t = axis(spark, n, start, way, "i", "target")
    src = F.rint(F.abs(F.col("target") - start) / abs(step)).cast("long")
    return t.withColumn("src", F.greatest(F.lit(0), F.least(F.lit(count - 1), src)))


def cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """(cell_id, row, col, x, y): every cell of a grid, generated in parallel; no product of axes is shuffled."""
    row, col = F.floor(F.col("cell_id") / grid.nx), F.col("cell_id") % grid.nx
    return spark.range(grid.nx * grid.ny).withColumnRenamed("id", "cell_id").select(
        "cell_id", row.alias("row"), col.alias("col"), (grid.x0 + col * grid.dx).alias("x"), (grid.y0 + row * grid.dy).alias("y"))


def source_cells(targets: DataFrame, source: Grid) -> DataFrame:
    """``targets`` (with x, y) and src_row, src_col, NULL where the source does not reach."""
    col, row = cell_index(F.col("x"), source.x0, source.dx), cell_index(F.col("y"), source.y0, source.dy)
    ok = inside(col, source.nx) & inside(row, source.ny)
    return targets.withColumns({"src_row": F.when(ok, row), "src_col": F.when(ok, col)})


def resample_nearest(targets: DataFrame, source: Grid, field: DataFrame, values: list[str], transposed: bool = False) -> DataFrame:
    """Every target with the values of its nearest source cell; NULL outside.

    An equi-join on computed indexes, so Spark prunes and picks the strategy; ``transposed`` fields are stored by
    (x, y), that is with row and col exchanged.
    """
    row, col = ("col", "row") if transposed else ("row", "col")
    side = field.select(F.col(row).cast("long").alias("src_row"), F.col(col).cast("long").alias("src_col"), *values)
    return source_cells(targets, source).join(side, ["src_row", "src_col"], "left")


def lookup(points: DataFrame, grid: Grid, mask: DataFrame, value: str, default: int) -> DataFrame:
    """Points with the class of their cell; the default outside the grid or without a cell."""
    out = resample_nearest(points, grid, mask, [value])
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def strided(field: DataFrame, step: int) -> DataFrame:
    """Each ``step``-th row and column, renumbered."""
    return field.where((F.col("row") % step == 0) & (F.col("col") % step == 0)).withColumns(
        {"row": F.floor(F.col("row") / step), "col": F.floor(F.col("col") / step)})


def gathered(field: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """The wanted rows and columns of a field: (i, row) and (j, col) say where each goes."""
    return field.join(F.broadcast(rows), "row").join(F.broadcast(cols), "col")


def aligned(base: DataFrame, *layers: DataFrame) -> DataFrame:
    """Layers over the same grid side by side, by cell."""
    for layer in layers:
        base = base.join(layer, "cell_id")
    return base


def neighbour_mean(field: DataFrame, value: str, along: str) -> DataFrame:
    """P20: values between cells: the mean of each cell and the next one along an axis."""
    other = "row" if along == "col" else "col"
    ahead = field.select((F.col(along) - 1).alias(along), other, F.col(value).alias("next_"))
    return field.join(ahead, [along, other]).withColumn(value, (F.col(value) + F.col("next_")) / 2).drop("next_")


def compact_codes(field: DataFrame, key: str) -> DataFrame:
    """(key, code): the distinct needed indexes, numbered from 0 in order."""
    from pyspark.sql import Window

    wanted = field.select(key).distinct()
    part = F.floor(F.col(key) / 4096)  # numbered within blocks, then moved by the blocks before: no single-task sort
    blocks = wanted.groupBy(part.alias("b")).count()
    before = blocks.withColumn("base", F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(key)) - 1
    return wanted.withColumn("b", part).withColumn("r", rank).join(before, "b").select(key, (F.col("r") + F.coalesce("base", F.lit(0))).cast("long").alias("code"))


def within(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], margin: float) -> DataFrame:
    """Points in a box (x0, y0, x1, y1) widened by a margin."""
    return df.where(F.col(x).between(box[0] - margin, box[2] + margin) & F.col(y).between(box[1] - margin, box[3] + margin))


def classify_water(model_water: Column, mask: Column, main_ice: Column) -> dict[str, Column]:
    """Open water (mask 0), cavities (mask 3 of the main ice body), and both."""
    still = model_water & (mask == 0)
    under = model_water & (mask == 3) & main_ice
    return {"open_water": still, "cavity": under, "water": still | under}
