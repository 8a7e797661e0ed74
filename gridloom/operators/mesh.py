"""Meshes, ribbons and arrows over grids, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import inside
from ..functions.palette import clamp, discharge_scale, lerp
from ..functions.validity import finite

# Fixed values of the shapes.
RIBBON = (1500.0, 5000.0)
HEAD_RATIO, HEAD_MIN, HEAD_MAX, HEAD_WIDTH, HEAD_TINT = 0.4, 0.16, 1.0, 0.65, 0.35
CLEARANCE = 20.0


def vertices(cells: DataFrame, stride: int, nx: int, ny: int) -> DataFrame:
    """Each ``stride``-th cell as a vertex (vr, vc) with its place (u, v) on the sheet."""
    cols, rows = (nx - 1) // stride + 1, (ny - 1) // stride + 1
    vr, vc = F.floor(F.col("row") / stride), F.floor(F.col("col") / stride)
    return cells.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0)).withColumns(
        {"vr": vr, "vc": vc, "vertex": vr * cols + vc, "u": vc / max(1, cols - 1), "v": F.lit(1.0) - vr / max(1, rows - 1)})


def triangles(verts: DataFrame, valid: str) -> DataFrame:
    """(vr, vc, half, a, b, c): up to two triangles a quad, each with its three vertices valid.

    Each vertex is dealt to the four quads that it is a corner of, and a quad is one group: one shuffle, and a
    third of it for nothing but corners, where a self-join would shuffle the sheet four times.
    """
    corner = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1))))
    dealt = verts.where(valid).select("vr", "vc", "vertex", corner.alias("k")).select((F.col("vr") - F.col("k.r")).alias("vr"), (F.col("vc") - F.col("k.c")).alias("vc"), "vertex", (F.col("k.r") * 2 + F.col("k.c")).alias("k"))
    at = {k: F.max(F.when(F.col("k") == k, F.col("vertex"))) for k in range(4)}
    quad = dealt.groupBy("vr", "vc").agg(*(at[k].alias(f"v{k}") for k in range(4)))
    two = F.array(*(F.struct(F.lit(h).alias("half"), F.col(f"v{a}").alias("a"), F.col(f"v{b}").alias("b"), F.col(f"v{c}").alias("c")) for h, a, b, c in ((0, 0, 2, 1), (1, 1, 2, 3))))
    return quad.select("vr", "vc", F.explode(two).alias("t")).select("vr", "vc", "t.*").where("a is not null and b is not null and c is not null")


def ribbons(channels: DataFrame, across: float) -> DataFrame:
    """Six vertices a channel. ``channels``: (id, x0, y0, z0, x1, y1, z1, q) in scene units; ``across`` is
    metres a unit. Channels without discharge or length give none."""
    dx, dz = F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0")
    length = F.hypot(dx, dz)
    half = lerp(*RIBBON, discharge_scale(F.col("q"))) / across / 2
    ok = channels.where(finite(F.col("q")) & (F.col("q") > 0) & (length > 1e-9)).withColumns({"nx_": -dz / length * half, "nz_": dx / length * half})
    at = lambda end, side: F.struct((F.col(f"x{end}") + side * F.col("nx_")).alias("x"), F.col(f"y{end}").alias("y"), (F.col(f"z{end}") + side * F.col("nz_")).alias("z"))
    six = F.array(at(0, 1), at(1, 1), at(0, -1), at(0, -1), at(1, 1), at(1, -1))
    return ok.select("id", "q", F.posexplode(six).alias("vertex", "p")).select("id", "q", "vertex", "p.*")


def arrows(segs: DataFrame) -> DataFrame:
    """Two lines from the tip of each terminal segment (x0..z1) back to the sides of its head."""
    d = {c: F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"}
    length = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    head = clamp(length * HEAD_RATIO, HEAD_MIN, HEAD_MAX)
    flat = F.hypot(d["x"] / length, d["z"] / length)
    level = flat >= 1e-6  # else the segment is upright, and its head lies across the other axis
    s = segs.where((F.col("terminal_flag") == 1) & (length > 1e-5)).withColumns({
        "bx": F.col("x1") - d["x"] / length * head, "by": F.col("y1") - d["y"] / length * head, "bz": F.col("z1") - d["z"] / length * head,
        "sx": F.when(level, -d["z"] / length / F.greatest(flat, F.lit(1e-12))).otherwise(0.0) * head * HEAD_WIDTH,
        "sz": F.when(level, d["x"] / length / F.greatest(flat, F.lit(1e-12))).otherwise(-F.signum(d["y"])) * head * HEAD_WIDTH})
    two = F.array(*(F.struct(F.lit(k).alias("side"), (F.col("bx") + k * F.col("sx")).alias("hx"), F.col("by").alias("hy"), (F.col("bz") + k * F.col("sz")).alias("hz")) for k in (1, -1)))
    return s.select("seg_id", F.col("x1").alias("tx"), F.col("y1").alias("ty"), F.col("z1").alias("tz"), F.explode(two).alias("h")).select("seg_id", "tx", "ty", "tz", "h.*")


def tinted(colour: Column) -> Column:
    """The arrow's colour: the line's, a good third towards white."""
    return F.transform(colour, lambda c: c + (1 - c) * HEAD_TINT)


def ocean_segments(segs: DataFrame, cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """Segments with both ends over ocean (mask 0 or 3) and clear of the bed.

    ``segs``: (seg_id, col0, row0, depth0, col1, row1, depth1, ...) in grid coordinates; ``cells``: (row, col, mask,
    bed). Ends are rows, joined once by cell: one shuffle of the cells, not two.
    """
    ends = F.explode(F.array(*(F.struct(F.floor(F.col(f"col{k}") + 0.5).cast("long").alias("col"), F.floor(F.col(f"row{k}") + 0.5).cast("long").alias("row"), F.col(f"depth{k}").alias("depth"), (inside(F.col(f"col{k}"), nx) & inside(F.col(f"row{k}"), ny) & (F.col(f"col{k}") <= nx - 1) & (F.col(f"row{k}") <= ny - 1)).alias("inside")) for k in (0, 1))))
    out = segs.select("seg_id", ends.alias("e")).where("e.inside").select("seg_id", "e.col", "e.row", "e.depth").join(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "mask", "bed"), ["row", "col"])
    good = out.where(F.col("mask").isin(0, 3) & finite(F.col("bed")) & (-F.col("bed") >= F.greatest(F.col("depth"), F.lit(0.0)) + CLEARANCE))
    both = good.groupBy("seg_id").count().where("count = 2").select("seg_id")
    return segs.join(both, "seg_id", "left_semi")


def pair_counts(segs: DataFrame, layer: str) -> DataFrame:
    """Lines to draw and segments of each layer; a terminal segment has two more for its head."""
    return segs.groupBy(layer).agg(F.sum(1 + 2 * F.col("terminal_flag")).alias("pairs"), F.count("*").alias("segments"))
