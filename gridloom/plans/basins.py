"""Drainage basins from polygon records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import polygon


def basins(parts: DataFrame) -> DataFrame:
    """(id, name, label_x, label_y, area_km2, rings), by id: ``parts`` as ``sources.staging.polygons`` gives them."""
    measured = polygon.basins(parts, "id", "ring")
    shapes = parts.groupBy("id").agg(F.first("name").alias("name"), F.array_sort(F.collect_list(F.struct("part", polygon.rounded(polygon.closed(F.col("ring"))).alias("ring")))).alias("p"))
    return shapes.join(measured, "id").select(
        "id", "name", F.rint("label_x").cast("int").alias("label_x"), F.rint("label_y").cast("int").alias("label_y"),
        F.round(F.col("area") / 1e6, 2).alias("area_km2"), F.transform("p", lambda x: x["ring"]).alias("rings")).orderBy("id")
