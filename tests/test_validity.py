"""Quantisation, statistics, axes and attributes on hand-written cases."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text, validity
from gridloom.operators import grid, stats

NAN = float("nan")


def values(spark, xs, column):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "i int, v double")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(("xs", "want"), [
    ([7.25, -31.75, 0.49, 12_345.6], [7, -32, 0, 12_346]),
    ([-9999.0, 3.0, -9999.0, -4.0], [-32768, 3, -32768, -4]),
    ([None, 17.0, NAN], [-32768, 17, -32768]),
    ([32_767.4, 40_000.0, -32_768.0, -1e7], [32767, 32767, -32767, -32767]),
    ([NAN, None], [-32768, -32768]),
    ([3.5, -3.5, 4.5, -0.5], [4, -4, 4, 0]),
])
def test_quantize(spark, xs, want):
    assert values(spark, xs, validity.quantize(validity.exact_sentinel(F.col("v")))) == want


def test_quantize_options(spark):
    assert values(spark, [1.0, -1e30, 2.0], validity.quantize(validity.exact_sentinel(F.col("v"), -1e30))) == [1, -32768, 2]
    assert values(spark, [500.0, -500.0], validity.quantize(F.col("v"), low=-100, high=100)) == [100, -100]
    assert values(spark, [200.0, -400.0, 1e6], validity.quantize(F.col("v"), scale=2)) == [100, -200, 32767]
    assert values(spark, [3.0], validity.dequantize(validity.quantize(F.col("v"), scale=0.5), 0.5)) == [3.0]


def test_rules(spark):
    inf = float("inf")
    assert values(spark, [-1.0, 0.0, 1.0, NAN, inf, None], validity.non_negative(F.col("v"))) == [None, 0.0, 1.0, None, None, None]
    assert values(spark, [-1.0, 0.0, 1.0], validity.positive(F.col("v"))) == [None, None, 1.0]
    assert values(spark, [1e20, 2e20, NAN], validity.not_huge(F.col("v"))) == [1e20, None, None]
    assert values(spark, [NAN, 7.5, -3.0, 1e9], validity.identifier(F.col("v"))) == [0, 8, 0, 65535]
    x, y = validity.paired_sentinel(F.col("v"), F.lit(1.0), -9999.0)
    assert values(spark, [-9999.0005, 5.0], x) == [None, 5.0]


@pytest.mark.parametrize(("xs", "want"), [
    ([2.5, -7.5, 11.0], (-7.5, 11, 2)), ([-9999.0, 8.0, NAN, 6.0, -9999.0], (6, 8, 7)), ([None, 0.25], (0.25, 0.25, 0.25)),
    ([1e6, 1e6, -9999.0], (1e6, 1e6, 1e6)), ([-3.0, -1.0, -1.0, -3.0], (-3, -1, -2)), ([None, -9999.0], (None, None, None)),
])
def test_stats(spark, xs, want):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = df.agg(*stats.stats(validity.exact_sentinel(F.col("v")))).first()
    assert tuple(got) == pytest.approx(want) if want[0] is not None else tuple(got) == want


def test_quantiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    q = df.agg(*stats.quantiles(F.col("v"))).first().asDict()
    assert q["median"] == 50.5 and q["median"] < q["q90"] < q["q95"] < q["q99"]
    empty = df.where("v < 0")
    assert empty.agg(*stats.quantiles(F.col("v"))).first()[0] is None
    assert tuple(empty.agg(*stats.percentile_range(F.col("v"), 2, 98)).first()) == (0.0, 1.0)


def test_merge_equals_recomputing(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).cast("double").alias("v"), (F.col("id") % 7).alias("k"))
    parts = df.groupBy("k").agg(*stats.stats(F.col("v")), F.count("v").alias("w"))
    assert tuple(stats.merged_stats(parts, "w").first())[:3] == pytest.approx(tuple(df.agg(*stats.stats(F.col("v"))).first()))
    assert tuple(stats.merged_stats(parts.where("k > 10"), "w").first()) == (0.0, 0.0, 0.0, 0)
    two = spark.createDataFrame([(1.0, 3.0, 2.0, 2), (0.0, 9.0, 5.0, 1), (NAN, 1.0, 1.0, 9)], "min double, max double, mean double, w int")
    assert tuple(stats.merged_stats(two, "w").first())[:3] == (0.0, 9.0, 3.0)


def test_axes(spark):
    up = grid.resolution_axis(spark, 100, 0.0, 100.0, 500.0).orderBy("i").collect()
    assert up[0].target == 0 and up[1].target == 500 and all(0 <= r.src < 100 for r in up)
    down = grid.resolution_axis(spark, 100, 10000.0, -100.0, 500.0).orderBy("i").collect()
    assert down[0].target == 10000 and down[1].target == 9500
    for bad in ((100, 0.0, 100.0, 0), (100, 0.0, 100.0, -100.0), (1, 0.0, 100.0, 500.0)):
        with pytest.raises(ValueError):
            grid.resolution_axis(spark, *bad)
    cells = grid.cells(spark, grid.Grid(5, 3, 0.0, 100.0, 10.0, -10.0)).orderBy("cell_id").collect()
    assert [c.x for c in cells[:5]] == [0, 10, 20, 30, 40] and sorted({c.y for c in cells}) == [80, 90, 100]


def test_nearest_index(spark):
    g = grid.Grid(3, 1, 0.0, 0.0, 100.0, 1.0)
    pts = spark.createDataFrame([(-100.0, 0.0), (0.0, 0.0), (100.0, 0.0), (500.0, 0.0)], "x double, y double")
    assert [r.src_col for r in grid.source_cells(pts, g).orderBy("x").collect()] == [None, 0, 1, None]


def test_attributes(spark):
    df = spark.createDataFrame([(None, None), (bytearray(b"caf\xc3\xa9"), None), (None, "x"), (bytearray(b"a\xff"), None)], "raw binary, txt string")
    assert [r[0] for r in df.select(text.decode_attr(F.col("txt"), F.col("raw"), "d")).collect()] == ["d", "café", "x", "a�"]
    f = spark.createDataFrame([(None,), (["-32768.0"],), ([],), (["abc"],)], "a array<string>")
    assert [r[0] for r in f.select(text.fill_value(F.col("a"), -1)).collect()] == [-1, -32768, -1, -1]


def test_projection_inverts_at_pole(spark):
    from gridloom.functions import geometry

    x, y = geometry.polar_stereographic(F.lit(70.0), F.lit(-45.0))
    row = spark.range(1).select(x, y).first()
    assert row[0] == pytest.approx(0, abs=1e-6) and row[1] == pytest.approx(-2187000, rel=0.01)
    assert math.isfinite(row[1])
