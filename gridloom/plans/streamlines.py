"""Streamlines of a water volume: masks, seeds, depths, traces, selection, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import sector
from ..operators import polyline, select, spatial, trace

COLUMNS = ("key", "mask_name", "retain_fraction", "candidate_factor", "min_total_depth_m", "depth_low", "depth_high", "proxy_fraction", "beta_a", "beta_b")
# The seed buckets of the mixed class.
MIXED = (
    ("cavity_front", "cavity_front", 0.25, 3.5, 180.0, 0.32, 0.92, 0.72, 1.6, 1.0),
    ("cavity_interior", "cavity_interior", 0.15, 3.5, 140.0, 0.22, 0.86, 0.58, 1.45, 1.15),
    ("open_front", "open_front", 0.25, 3.5, 250.0, 0.40, 0.92, 0.68, 1.55, 1.0),
    ("open_mid", "open_mid", 0.15, 3.5, 300.0, 0.35, 0.72, 0.56, 1.35, 1.35),
    ("open_lower", "open_lower", 0.20, 3.5, 700.0, 0.62, 0.94, 0.80, 2.1, 1.0),
)
MARGINS = {"cavity_margin_50km": 50_000.0, "cavity_margin_80km": 80_000.0}


def bucket_table(spark: SparkSession, kind: str, rows: tuple = MIXED) -> DataFrame:
    """The seed buckets of a class as a small table; other classes than these are an error. The margin
    and remote classes take their own rows."""
    if kind not in ("legacy_multi_bucket", *MARGINS, "remote_open_ocean"):
        raise ValueError(f"no such class: {kind}")
    types = " ".join(f"{c} {'string' if k < 2 else 'double'}," for k, c in enumerate(COLUMNS)).rstrip(",")
    return spark.createDataFrame(list(rows), types)


def seed_masks(kind: str, open_water: DataFrame, cavity: DataFrame, cell: float, nx: int, ny: int) -> dict[str, DataFrame]:
    """The cells that each bucket of a class may seed."""
    if kind in MARGINS:
        return {kind: spatial.margin(cavity, open_water, MARGINS[kind], cell, nx, ny)}
    if kind == "remote_open_ocean":
        return {kind: spatial.remote(cavity, open_water, nx, ny, cell)}
    near = spatial.front(cavity, open_water, 2, nx, ny)
    front = spatial.front(open_water, cavity, 2, nx, ny)
    rest = open_water.join(front, ["row", "col"], "left_anti")
    return {"cavity_front": near, "cavity_interior": cavity.join(near, ["row", "col"], "left_anti"), "open_front": front, "open_mid": rest, "open_lower": rest}


def seeds(masks: dict[str, DataFrame], buckets: DataFrame, column: DataFrame, target: int, seed: int = 115) -> DataFrame:
    """(seed_id, bucket, x, y, depth): scattered cells of each bucket's mask with room enough, and
    reproducible depths in its range. ``column``: (row, col, top, bottom) of the water."""
    quota = {r.key: r for r in buckets.collect()}  # some dozen rows of settings
    out = None
    for name, b in sorted(quota.items()):
        room = masks[b.mask_name].join(column, ["row", "col"]).where(F.col("bottom") - F.col("top") >= b.min_total_depth_m)
        want = int(target * b.retain_fraction * b.candidate_factor) + 1
        got = spatial.scattered(room, want, None, seed).join(column, ["row", "col"])
        got = got.withColumn("seed_id", F.pmod(F.xxhash64("row", "col", F.lit(name)), F.lit(1 << 53)))
        deep = trace.seed_depths(got, "seed_id", "top", "bottom", b.depth_low, b.depth_high, draws=1, seed=seed)
        part = deep.select("seed_id", F.lit(name).alias("bucket"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "depth")
        out = part if out is None else out.unionByName(part)
    return out


def streamlines(starts: DataFrame, volume: trace.Volume, buckets: DataFrame, target: int, bin_side: int = 8, **walk) -> DataFrame:
    """(cand_id, position, bucket, pts, segment_count): traced seeds, chosen by quota."""
    lines = trace.streamlines(starts, volume, **walk).join(starts, "seed_id")
    quotas = {r.key: r.slots for r in select.bucket_targets(buckets.select(F.row_number().over(select.one().orderBy("key")).alias("idx"), "key", F.col("retain_fraction").alias("fraction")), target)
              .join(buckets.select("key", F.row_number().over(select.one().orderBy("key")).alias("idx")), "idx").collect()}
    rows, cols = volume.water.shape
    c = spatial.bins(lines.withColumns({"row": F.rint("y"), "col": F.rint("x")}), bin_side).select(
        F.col("seed_id").alias("cand_id"), "bucket", "bin_row", "bin_col", "depth", F.col("segment_count").alias("segments"), F.col("displacement").alias("second"),
        F.col("bucket").contains("front").alias("front"), sector(F.col("x") - (cols - 1) / 2, F.col("y") - (rows - 1) / 2).alias("sector"))
    chosen = select.select_separated(c, quotas)
    return chosen.join(lines.withColumnRenamed("seed_id", "cand_id"), "cand_id").select("cand_id", "position", "bucket", "pts", "segment_count")


def segments(lines: DataFrame) -> DataFrame:
    """One row a segment, ends a and b, in the order of the chosen lines."""
    return polyline.array_segments(lines, "pts")
