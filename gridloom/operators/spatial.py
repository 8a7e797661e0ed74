"""Masks as sets of cells: bins, dilation, margins, connected bodies, spatial sampling."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import sector, unit_hash
from ..shipping import durable


def bin_size(valid: int, target: int, low: int = 6, high: int = 12) -> int:
    """Side of a spatial bin for about ``target`` bins."""
    return int(min(high, max(low, round(math.sqrt(valid / max(1, target))))))


def bins(df: DataFrame, size: int) -> DataFrame:
    """bin_row and bin_col of each cell."""
    return df.withColumns({"bin_row": F.floor(F.col("row") / size), "bin_col": F.floor(F.col("col") / size)})


def dilate(cells: DataFrame, radius: int, nx: int, ny: int) -> DataFrame:
    """The cells within a square of ``radius`` around any cell of a set, clipped to the grid.

    Square dilation is separable: first along rows, then along columns, so a cell makes 2 * (2r + 1) rows at most
    and each step is one map-side combined distinct.
    """
    spread = lambda c, n: F.explode(F.sequence(F.greatest(F.col(c).cast("long") - radius, F.lit(0)), F.least(F.col(c).cast("long") + radius, F.lit(n - 1))))
    across = cells.select(F.col("row").cast("long").alias("row"), spread("col", nx).alias("col")).distinct()
    return across.select(spread("row", ny).alias("row"), "col").distinct()


def margin(cavity: DataFrame, water: DataFrame, metres: float, cell: float, nx: int, ny: int) -> DataFrame:
    """The cavity and the open water within some distance of it."""
    near = water.select("row", "col").join(dilate(cavity, math.ceil(metres / cell), nx, ny), ["row", "col"], "left_semi")
    return near.union(cavity.select("row", "col")).distinct()


def remote(cavity: DataFrame, water: DataFrame, nx: int, ny: int, cell: float, metres: float = 80_000.0) -> DataFrame:
    """Open water outside the margin."""
    return water.select("row", "col").join(margin(cavity, water, metres, cell, nx, ny), ["row", "col"], "left_anti")


def front(inner: DataFrame, other: DataFrame, radius: int, nx: int, ny: int) -> DataFrame:
    """The cells of one mask that lie near another."""
    return inner.select("row", "col").join(dilate(other, radius, nx, ny), ["row", "col"], "left_semi")


def components(cells: DataFrame, nx: int) -> DataFrame:
    """G1: (row, col, component): bodies joined over sides and corners, named by their least flat index.

    Minimum labels spread to neighbours and then along the labels themselves (pointer jumping), which takes about
    log(diameter) rounds rather than one for each step; each round is equi-joins and map-side combined minima.
    """
    flat = F.col("row").cast("long") * nx + F.col("col").cast("long")
    own = durable(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), flat.alias("id")).distinct())
    steps = F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))))
    ahead = own.withColumn("s", F.explode(steps)).select("id", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    edges = ahead.join(own.withColumnRenamed("id", "other"), ["row", "col"]).select("id", "other")
    edges = durable(edges.union(edges.select("other", "id")))
    label, mark = own.select("id", F.col("id").alias("label")), None
    while True:
        seen = edges.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        hooked = label.join(seen, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        # a label that meets a lower one passes it on to all cells that carry it
        better = hooked.groupBy("label").agg(F.min("low").alias("low"))
        label = durable(hooked.select("id", "label").join(better, "label").select("id", F.col("low").alias("label")))
        now = label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == mark:
            return own.join(label, "id").select("row", "col", F.col("label").alias("component"))
        mark = now


def component_of(cells: DataFrame, row: int, col: int, nx: int) -> DataFrame:
    """G1: (row, col) of the body that has a cell; nothing if the cell is not set."""
    all_of = components(cells, nx)
    seed = all_of.where((F.col("row") == row) & (F.col("col") == col)).select("component")
    return all_of.join(F.broadcast(seed), "component", "left_semi").select("row", "col")


def nearest_cell(cells: DataFrame, x: Column, y: Column, nx: int) -> DataFrame:
    """A10: (row, col) of the cell nearest to the origin; of equals the one with the least flat index."""
    key = F.struct((x * x + y * y).alias("d"), (F.col("row") * nx + F.col("col")).alias("i"))
    return cells.agg(F.min_by(F.struct("row", "col"), key).alias("c")).select("c.*")


def main_component(cells: DataFrame, x: Column, y: Column, nx: int) -> DataFrame:
    """The body that has the cell nearest to the origin."""
    all_of = components(cells, nx)
    seed = nearest_cell(cells, x, y, nx)
    return all_of.join(all_of.join(F.broadcast(seed), ["row", "col"]).select("component"), "component", "left_semi").select("row", "col")


def fastest_in_block(df: DataFrame, size: int, value: str) -> DataFrame:
    """The cell with the largest value of each block; of equals the last in grid order."""
    best = F.max_by(F.struct("row", "col", value), F.struct(value, "row", "col")).alias("c")
    return bins(df, size).groupBy("bin_row", "bin_col").agg(best).select("bin_row", "bin_col", "c.*")


def sector_counts(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """(sector, count) of the eight sectors, zeros too."""
    got = points.groupBy(sector(x, y).alias("sector")).count()
    return points.sparkSession.range(8).select(F.col("id").cast("int").alias("sector")).join(got, "sector", "left").select("sector", F.coalesce("count", F.lit(0)).alias("count"))


def scattered(cells: DataFrame, target: int, weight: str | None, seed: int) -> DataFrame:
    """``target`` cells, or all if there are fewer: one cell a block, at random or by weight ** 1.5, in two to
    eight passes with blocks at random offsets, and what is still missing in hash order.

    A draw by weight is the least exponential variate, -log(u) / w, of a block: an aggregate, not a sort. Cells
    without a weight count only in blocks that have no other.
    """
    valid = cells.count()
    side = max(2, round(math.sqrt(valid / max(1, target))))
    passes = max(2, min(8, math.ceil(target / max(1, valid / side**2))))
    rng = random.Random(seed)
    offset = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(rng.randrange(side)).alias("r"), F.lit(rng.randrange(side)).alias("c")) for p in range(passes)))
    spread = cells.withColumn("o_", F.explode(offset)).where((F.col("row") >= F.col("o_.r")) & (F.col("col") >= F.col("o_.c")))
    u = F.greatest(unit_hash(F.col("row"), F.col("col"), F.col("o_.p"), F.lit(seed)), F.lit(1e-15))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    some = F.coalesce((w > 0) & (w < float("inf")), F.lit(False))
    draw = F.struct((~some).alias("none"), (-F.log(u) / F.when(some, F.pow(w, F.lit(1.5))).otherwise(1.0)).alias("d"), "row", "col")
    place = F.struct("pass", "block_row", "block_col")
    picked = spread.groupBy(F.col("o_.p").alias("pass"), F.floor((F.col("row") - F.col("o_.r")) / side).alias("block_row"), F.floor((F.col("col") - F.col("o_.c")) / side).alias("block_col")).agg(F.min_by(F.struct("row", "col"), draw).alias("c"))
    first = picked.groupBy("c.row", "c.col").agg(F.min(place).alias("at"))
    ranked = cells.select("row", "col").distinct().join(first, ["row", "col"], "left")
    return ranked.orderBy(F.col("at").isNull(), "at", unit_hash(F.col("row"), F.col("col"), F.lit(seed)), "row", "col").limit(max(0, target)).select("row", "col")


def poisson_disk(cells: DataFrame, radius: int, seed: int) -> DataFrame:
    """A maximal set of cells no two of which are nearer than ``radius``, in hash order.

    Rounds of a parallel greedy pass: a cell is taken when no cell still in play within the radius has a smaller
    hash, and then silences its surroundings. The result is what going through the cells in hash order one by
    one gives. Neighbours meet through bins of the radius' size and the eight around.
    """
    play = durable(cells.select("row", "col", unit_hash(F.col("row"), F.col("col"), F.lit(seed)).alias("h")).distinct())
    taken = play.limit(0).select("row", "col")
    near3 = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))

    def around(df: DataFrame) -> DataFrame:
        wide = bins(df, max(1, radius)).withColumn("n", near3)
        return wide.select((F.col("bin_row") + F.col("n.a")).alias("bin_row"), (F.col("bin_col") + F.col("n.b")).alias("bin_col"), F.col("row").alias("r2"), F.col("col").alias("c2"), *([F.col("h").alias("h2")] if "h" in df.columns else []))

    close = (F.col("row") - F.col("r2")) ** 2 + (F.col("col") - F.col("c2")) ** 2 < radius * radius
    while play.take(1):
        here = bins(play, max(1, radius))
        before = here.join(around(play), ["bin_row", "bin_col"]).where(close & (F.struct("h2", "r2", "c2") < F.struct("h", "row", "col"))).select("row", "col").distinct()
        won = durable(play.join(before, ["row", "col"], "left_anti").select("row", "col"))
        lost = here.join(around(won), ["bin_row", "bin_col"]).where(close).select("row", "col").distinct()
        play = durable(play.join(lost, ["row", "col"], "left_anti").join(won, ["row", "col"], "left_anti"))
        taken = taken.union(won)
    return taken


def poisson_target(cells: DataFrame, target: int, extent: int, seed: int, rounds: int = 14) -> DataFrame:
    """A Poisson-disk set of at least ``target`` cells with the largest radius that a binary search finds, cut
    to the target in hash order; all cells in hash order if there are no more than that."""
    order = [unit_hash(F.col("row"), F.col("col"), F.lit(seed)), F.col("row"), F.col("col")]
    if cells.count() <= target:
        return cells.select("row", "col").orderBy(*order)
    low, high, best = 0, extent, cells.select("row", "col")
    for _ in range(rounds):
        r = (low + high) // 2
        if r <= low:
            break
        got = poisson_disk(cells, r, seed)
        if got.count() >= target:
            low, best = r, got
        else:
            high = r
    return best.orderBy(*order).limit(target)


def ranked_in_bin(df: DataFrame, by: list[Column]) -> DataFrame:
    """Rank of each candidate within its bin."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("bin_row", "bin_col").orderBy(*by)))
