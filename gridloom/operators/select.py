"""Quotas and quota-driven selection of streamlines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import sector, unit_hash
from ..shipping import durable


def one():
    """A window over a whole table of buckets, some dozen rows at most."""
    return Window.partitionBy(F.lit(0))



def bucket_targets(buckets: DataFrame, total: int) -> DataFrame:
    """Slots by fraction, the largest remainders rounded up; of equal remainders the later index first.

    ``buckets``: (idx, fraction).
    """
    raw = F.col("fraction") * total
    base = F.floor(raw)
    b = buckets.withColumns({"base": base.cast("long"), "rest": raw - base})
    order = F.row_number().over(one().orderBy(F.desc("rest"), F.desc("idx")))
    left = F.lit(total) - F.sum("base").over(one())
    return b.select("idx", (F.col("base") + (order <= left).cast("long")).alias("slots"))


def weighted_targets(buckets: DataFrame, total: int) -> DataFrame:
    """A slot for each positive weight, heaviest first; the rest in proportion, the largest remainders rounded
    up, of equals the earlier index first. ``buckets``: (idx, weight)."""
    pos = F.col("weight") > 0
    b = buckets.withColumn("heavy", F.row_number().over(one().orderBy(F.desc(F.when(pos, F.col("weight"))), F.asc("idx"))))
    count, weight = F.sum(pos.cast("long")).over(one()), F.sum(F.when(pos, F.col("weight"))).over(one())
    b = b.withColumns({"first": (pos & (F.col("heavy") <= total)).cast("long"), "rest_total": F.greatest(F.lit(0), F.lit(total) - count), "share": F.when(pos, F.try_divide(F.col("weight"), weight))})
    raw = F.coalesce(F.col("share") * F.col("rest_total"), F.lit(0.0))
    b = b.withColumns({"base": F.floor(raw).cast("long"), "rest": F.when(pos, raw - F.floor(raw))})
    left = F.col("rest_total") - F.sum("base").over(one())
    order = F.row_number().over(one().orderBy(F.desc_nulls_last("rest"), F.asc("idx")))
    return b.withColumns({"left_": left, "order_": order}).select("idx", (F.col("first") + F.col("base") + (pos & (F.col("order_") <= F.col("left_"))).cast("long")).alias("slots"))


def round_robin(df: DataFrame, by: list[Column], k: int, bin_order: Column) -> DataFrame:
    """K candidates, one of each bin in turn, best first; bins in a given order. For candidates that
    don't reject each other."""
    rank = F.row_number().over(Window.partitionBy("bin_row", "bin_col").orderBy(*by))
    return df.withColumns({"rank": rank, "turn": bin_order}).orderBy("rank", "turn").limit(k)


def hashed_order(df: DataFrame, key: list[str], seed: int) -> Column:
    """A reproducible random order."""
    return unit_hash(*(F.col(k) for k in key), F.lit(seed))


def select_separated(candidates: DataFrame, quotas: dict[str, int], separation: float = 120.0, front_bonus: bool = True, seed: int = 0) -> DataFrame:
    """Candidate ids chosen by quota, spread over bins and sectors, apart in depth.

    ``candidates``: (cand_id, bucket, bin_row, bin_col, depth, segments, second, front, sector). In a bin no two
    chosen seeds are nearer in depth than ``separation``; that list is shared by all buckets.

    First each bucket takes its quota bin by bin in turn; a rejected candidate does not use up its bin's turn. What a
    bin accepts depends on that bin alone, so bins are gone through in parallel, each sorted and streamed, and the
    first of all by round and turn are the bucket's. What quotas leave open is filled from the least filled sector
    first, fronts before others; candidates too near to what is kept never come, and each sector's best are fetched
    anew when they run out. So the driver holds some quotas' worth of candidates, and none is left out untried.
    """
    order = [F.desc("front") if front_bonus else F.lit(0), F.desc("segments"), F.desc("second"), F.asc("cand_id")]
    spark = candidates.sparkSession
    pool = durable(candidates.withColumn("turn", unit_hash(F.col("bin_row"), F.col("bin_col"), F.lit(seed))))
    kept: dict[tuple, list[float]] = {}
    chosen: list[tuple] = []
    sectors = np.zeros(8, int)

    def near(depth: float, depths: Iterable[float]) -> bool:
        return any(abs(depth - d) < separation for d in depths)

    def keep(c) -> None:
        kept.setdefault((c.bin_row, c.bin_col), []).append(c.depth)
        chosen.append((c.cand_id, c.bin_row, c.bin_col, c.depth))
        sectors[int(c.sector)] += 1

    for bucket, quota in quotas.items():
        held = {k: list(v) for k, v in kept.items()}

        def accepted(frames: Iterable[pd.DataFrame], held: dict = held, quota: int = quota) -> Iterator[pd.DataFrame]:
            at, depths, n = None, [], 0
            for f in frames:
                take = []
                for c in f.itertuples():
                    if (c.bin_row, c.bin_col) != at:
                        at, n = (c.bin_row, c.bin_col), 0
                        depths = list(held.get(at, ()))
                    ok = n < quota and not near(c.depth, depths)
                    take.append(n if ok else -1)
                    if ok:
                        depths.append(c.depth)
                        n += 1
                yield f.assign(round=np.array(take, np.int64))[np.array(take, np.int64) >= 0]

        rows = pool.where(F.col("bucket") == bucket).select("cand_id", "bin_row", "bin_col", F.col("depth").cast("double").alias("depth"), "sector", "turn", "front", "segments", "second")
        rows = rows.repartition("bin_row", "bin_col").sortWithinPartitions("turn", "bin_row", "bin_col", *order).drop("front", "segments", "second")
        found = rows.mapInPandas(accepted, "cand_id long, bin_row long, bin_col long, depth double, sector int, turn double, round long")
        for c in found.orderBy("round", "turn", "bin_row", "bin_col").limit(quota).collect():
            keep(c)
    total, more = sum(quotas.values()), True
    while more and len(chosen) < total:
        size = max(64, total - len(chosen))
        taken = F.broadcast(spark.createDataFrame(chosen, "i_ long, r_ long, c_ long, d_ double"))  # no more than the quotas
        rest = pool.join(taken, (F.col("cand_id") == F.col("i_")) | ((F.col("bin_row") == F.col("r_")) & (F.col("bin_col") == F.col("c_")) & (F.abs(F.col("depth") - F.col("d_")) < separation)), "left_anti")
        best = rest.withColumn("n_", F.row_number().over(Window.partitionBy("sector").orderBy(*order))).where(F.col("n_") <= size)
        queues: dict[int, list] = {}
        for c in best.select("cand_id", F.col("bin_row").cast("long").alias("bin_row"), F.col("bin_col").cast("long").alias("bin_col"), F.col("depth").cast("double").alias("depth"), "sector", "n_").orderBy(F.desc("n_")).collect():
            queues.setdefault(c.sector, []).append(c)
        full = {s for s, q in queues.items() if len(q) == size}
        more = False
        while len(chosen) < total and any(queues.values()) and not more:
            s = min((s for s in queues if queues[s]), key=lambda s: (sectors[int(s)], s))
            while queues[s]:
                c = queues[s].pop()
                if not near(c.depth, kept.get((c.bin_row, c.bin_col), ())):
                    keep(c)
                    break
            more = s in full and not queues[s]
    return spark.createDataFrame([(c[0], k) for k, c in enumerate(chosen)], "cand_id long, position long")


def with_sector(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumn("sector", sector(F.col(x), F.col(y)))
