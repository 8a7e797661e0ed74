"""Undirected edges between grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import inside
from ..functions.validity import finite


def kept_edges(edges: DataFrame, nx: int, ny: int, least: float) -> DataFrame:
    """Both ends (col1, row1, col2, row2) on the grid and different, discharge q finite and large enough."""
    ends = inside(F.col("col1"), nx) & inside(F.col("col2"), nx) & inside(F.col("row1"), ny) & inside(F.col("row2"), ny)
    loop = (F.col("col1") == F.col("col2")) & (F.col("row1") == F.col("row2"))
    return edges.where(ends & ~loop & finite(F.col("q").cast("double")) & (F.col("q") >= least))


def collapse(edges: DataFrame, nx: int) -> DataFrame:
    """One edge a pair of cells, whichever way round, with the largest discharge and how many it stands for."""
    a, b = F.col("row1") * F.lit(nx) + F.col("col1"), F.col("row2") * F.lit(nx) + F.col("col2")
    pairs = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"), "q")
    best = pairs.groupBy("a", "b").agg(F.max("q").alias("q"), F.count("*").alias("kept"))
    at = lambda c: ((c % nx), F.floor(c / nx))
    (c1, r1), (c2, r2) = at(F.col("a")), at(F.col("b"))
    return best.select(c1.alias("col1"), r1.alias("row1"), c2.alias("col2"), r2.alias("row2"), "q", "kept")
