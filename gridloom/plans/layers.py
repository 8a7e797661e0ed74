"""What is drawn: layers joined to the base grid, filtered, coloured, and laid out as meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import palette
from ..functions.geometry import lift
from ..functions.validity import finite
from ..operators import mesh

TASKS = ("velocity", "friction", "pressure")


def surface_layer(base: DataFrame, layer: DataFrame, task: str, stride: int, nx: int, ny: int) -> tuple[DataFrame, DataFrame]:
    """(vertices with height and colour, triangles). ``base``: (cell_id, row, col, mask, bed, surface);
    ``layer``: (cell_id, vx, vy), (cell_id, friction) or (cell_id, pressure)."""
    if task not in TASKS:
        raise ValueError(f"no such task: {task}")
    j = base.join(layer, "cell_id", "left")
    if task == "velocity":
        speed = F.hypot("vx", "vy")
        valid, colour, below = finite(F.col("surface")) & finite(speed), palette.stops(palette.velocity_scale(speed), palette.VELOCITY), F.col("surface")
    elif task == "friction":
        v = F.col("friction")
        valid, colour, below = finite(F.col("bed")) & (F.col("mask") == 2) & finite(v) & (v >= 0), palette.stops(palette.friction_scale(v), palette.FRICTION), F.col("bed")
    else:
        v = F.col("pressure")
        valid, colour, below = finite(F.col("bed")) & finite(v) & (v > 0), palette.stops(palette.pressure_scale(v), palette.PRESSURE), F.col("bed")
    verts = mesh.vertices(j, stride, nx, ny).withColumns({"valid": F.coalesce(valid, F.lit(False)), "height": below + lift(stride, task), "colour": colour})
    return verts, mesh.triangles(verts, "valid")
