"""Masks, edges, lines, rings, selection, tracing and packages on small cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import edges, interp, mesh, polygon, polyline, select, spatial, trace
from gridloom.sources import package


def cells(spark, xs):
    return spark.createDataFrame(sorted(xs), "row int, col int")


def as_set(df):
    return {(r[0], r[1]) for r in df.select("row", "col").collect()}


def test_edges(spark):
    rows = [(0, 0, 1, 0, 2.0), (1, 0, 0, 0, 5.0), (2, 2, 2, 2, 9.0), (0, 0, 9, 0, 9.0), (0, 1, 1, 1, 1e-9), (0, 1, 1, 1, float("nan"))]
    e = spark.createDataFrame(rows, "col1 int, row1 int, col2 int, row2 int, q double")
    got = edges.collapse(edges.kept_edges(e, 4, 3, 1e-3), 4).collect()
    assert len(got) == 1 and got[0].q == 5.0 and got[0].kept == 2


def test_dilation_and_components(spark):
    assert as_set(spatial.dilate(cells(spark, {(0, 0)}), 2, 10, 10)) == {(a, b) for a in range(3) for b in range(3)}
    rng = random.Random(3)
    xs = {(rng.randrange(25), rng.randrange(25)) for _ in range(230)}
    want, left = {}, set(xs)
    while left:
        seed = min(left)
        body, todo = {seed}, [seed]
        while todo:
            a, b = todo.pop()
            for n in {(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left - body:
                body.add(n)
                todo.append(n)
        want |= dict.fromkeys(body, min(a * 25 + b for a, b in body))
        left -= body
    got = {(r.row, r.col): r.component for r in spatial.components(cells(spark, xs), 25).collect()}
    assert got == want
    seed = min(xs)
    assert as_set(spatial.component_of(cells(spark, xs), *seed, 25)) == {c for c in xs if want[c] == want[seed]}
    assert spatial.components(cells(spark, {(0, 0)}).where("row > 5"), 25).count() == 0


def test_poisson_disk(spark):
    xs = {(a, b) for a in range(20) for b in range(20)}
    got = as_set(spatial.poisson_disk(cells(spark, xs), 4, 1))
    near = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 < 16
    assert not any(near(p, q) for p in got for q in got if p < q)
    assert all(any(near(p, q) for q in got) for p in xs)  # maximal
    assert spatial.poisson_target(cells(spark, xs), 30, 20, 1).count() == 30


def test_quotas(spark):
    b = spark.createDataFrame([(k, 0.25) for k in range(4)], "idx int, fraction double")
    assert [r.slots for r in select.bucket_targets(b, 10).orderBy("idx").collect()] == [2, 2, 3, 3]
    w = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 1.0)], "idx int, weight double")
    assert [r.slots for r in select.weighted_targets(w, 2).orderBy("idx").collect()] == [0, 1, 1]
    assert [r.slots for r in select.weighted_targets(w, 4).orderBy("idx").collect()] == [0, 3, 1]


def test_selection_keeps_apart(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.randrange(3), rng.randrange(3), rng.uniform(0, 900), rng.randrange(50), 0.0, rng.random() < 0.3, rng.randrange(8)) for k in range(400)]
    c = spark.createDataFrame(rows, "cand_id long, bucket string, bin_row int, bin_col int, depth double, segments int, second double, front boolean, sector int")
    got = {r.cand_id for r in select.select_separated(c, {"a": 12, "b": 12}).collect()}
    assert len(got) == 24
    by = {}
    for r in rows:
        if r[0] in got:
            by.setdefault(r[2:4], []).append(r[4])
    assert all(abs(p - q) >= 120 for d in by.values() for i, p in enumerate(d) for q in d[:i])


@pytest.mark.parametrize(("t", "want"), [(-1.0, None), (0.0, 1.0), (5.0, 1.5), (10.0, 2.0), (20.0, 3.0), (30.0, 4.0), (31.0, None)])
@pytest.mark.parametrize("right", [False, True])
def test_profile(spark, t, want, right):
    d, v = F.array(*map(F.lit, (0.0, 10.0, 30.0))), F.array(*map(F.lit, (1.0, 2.0, 4.0)))
    assert spark.range(1).select(interp.profile(d, v, F.lit(t), right)).first()[0] == want


def test_rings(spark):
    pt = lambda *xs: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xs))
    square, line = pt((0, 0), (1, 0), (1, 1), (0, 1)), pt((0, 0), (1, 1))
    r = spark.range(1).select(polygon.measures(square).alias("s"), polygon.measures(line).alias("l"), polygon.rounded(square).alias("r")).first()
    assert tuple(r.s) == pytest.approx((1, 0.5, 0.5)) and tuple(r.l) == (0.0, None, None)
    b = spark.range(1).select(F.lit(1).alias("k"), F.lit(0).alias("part"), square.alias("ring"))
    assert tuple(polygon.basins(b, "k", "ring").first()) == pytest.approx((1, 1.0, 0.5, 0.5))


def test_lines(spark):
    p = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(4)] + [(2, 0, 5.0, 5.0)], "line int, i int, x double, y double")
    s = polyline.segments(p, "line", "i", ["x", "y"]).orderBy("i").collect()
    assert [r.terminal_flag for r in s] == [0, 0, 1] and s[2].x1 == 3.0
    arr = p.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("pts"))
    assert polyline.array_segments(arr, "pts").count() == 3
    e = spark.createDataFrame([(k, 10) for k in range(5)], "o long, n int")
    assert [r.off for r in polyline.exclusive_sum(e, "o", "n", "off", block=2).orderBy("o").collect()] == [0, 10, 20, 30, 40]


def test_arrow_of_upright_segment(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1)], "seg_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, terminal_flag int")
    got = mesh.arrows(s).collect()
    assert len(got) == 2 and got[0].hy == pytest.approx(0.6) and abs(got[0].hz) == pytest.approx(0.4 * 0.65)


def test_trace_of_solid_rotation(spark):
    n = 61
    y, x = np.mgrid[0:n, 0:n].astype(float)
    f = {"u": np.stack([-(y - 30)] * 2), "v": np.stack([x - 30] * 2), "w": np.zeros((2, n, n)), "theta": np.stack([x] * 2), "sal": np.stack([y] * 2)}
    vol = trace.Volume(np.array([0.0, 500.0]), f, np.zeros((n, n)), np.full((n, n), 500.0), np.ones((n, n), bool), bilinear=True)
    seeds = spark.createDataFrame([(1, 40.0, 30.0, 100.0), (2, 40.0, 30.0, 499.0), (3, -5.0, 1.0, 50.0)], "seed_id long, x double, y double, depth double")
    got = trace.streamlines(seeds, vol, steps=50, step=0.1).collect()
    assert [r.seed_id for r in got] == [1] and got[0].segment_count == 100  # too near the bottom, and off the grid
    radius = [((p.x - 30) ** 2 + (p.y - 30) ** 2) ** 0.5 for p in got[0].pts]
    assert max(radius) < 10.3 and min(radius) > 9.99
    nearest = trace.Volume(np.array([0.0, 500.0]), f, np.zeros((n, n)), np.full((n, n), 500.0), np.ones((n, n), bool))
    assert trace.streamlines(seeds, nearest, steps=50, step=0.1).count() == 1


def test_package_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(k, k - 50, k % 5, k / 8) for k in range(101)], "i long, h int, m int, q double")
    base = str(tmp_path / "pack")
    desc = {"title": "t", "grid": {"nx": 101, "ny": 1, "x0_m": 0.0, "y0_m": 0.0, "dx_m": 1.0, "dy_m": -1.0}}
    meta = package.write(df, "i", [("m", "uint8"), ("h", "int16"), ("q", "float32")], base, desc)
    assert [f["byte_offset"] for f in meta["fields"]] == [0, 101, 303]  # the last two are not aligned
    metas = package.metadata(spark, f"{base}.meta.json")
    assert package.problems(metas).count() == 0
    got = package.read_fields(spark, f"{base}.bin", metas)
    q = [r.raw for r in got.where("name = 'q'").orderBy("i").collect()]
    assert q == [k / 8 for k in range(101)]
    bad = json.loads((tmp_path / "pack.meta.json").read_text())
    bad["fields"][1]["byte_offset"], bad["fields"][0]["dtype"] = 50, "int64"
    (tmp_path / "bad.meta.json").write_text(json.dumps(bad))
    assert {"overlap", "dtype"} <= {r.problem for r in package.problems(package.metadata(spark, str(tmp_path / "bad.meta.json"))).collect()}
    files = package.listing(spark, str(tmp_path))
    need = spark.createDataFrame([("pack.bin",), ("none.bin",)], "entry string")
    assert [r.entry for r in package.missing(files, need).collect()] == ["none.bin"]
    with pytest.raises(ValueError):
        package.combine(df)


def test_colour_table(spark, tmp_path):
    (tmp_path / "c.rgb").write_text("ncolors=2\n# r g b\n0 0 0\n255 51 0\n")
    assert [(r.r, r.g) for r in package.colour_table(spark, str(tmp_path / "c.rgb")).orderBy("i").collect()] == [(0.0, 0.0), (1.0, 0.2)]


def test_selection_is_the_plain_greedy_one(spark):
    from gridloom.functions.geometry import unit_hash

    rng = random.Random(2)
    rows = [(k, rng.choice("ab"), rng.randrange(3), rng.randrange(3), rng.uniform(0, 900), rng.randrange(50), 0.0, rng.random() < 0.3, rng.randrange(8)) for k in range(600)]
    c = spark.createDataFrame(rows, "cand_id long, bucket string, bin_row int, bin_col int, depth double, segments int, second double, front boolean, sector int")
    turn = {(r.bin_row, r.bin_col): r.t for r in c.select("bin_row", "bin_col", unit_hash(F.col("bin_row"), F.col("bin_col"), F.lit(0)).alias("t")).distinct().collect()}
    for quotas in ({"a": 12, "b": 12}, {"a": 40, "b": 4}, {"a": 3, "none": 30}):
        kept, chosen, sectors = {}, [], [0] * 8

        def take(r, kept=kept, chosen=chosen, sectors=sectors):
            depths = kept.setdefault(r[2:4], [])
            if any(abs(r[4] - d) < 120 for d in depths):
                return False
            depths.append(r[4])
            chosen.append(r[0])
            sectors[r[8]] += 1
            return True

        ranked = sorted(rows, key=lambda r: (-r[7], -r[5], -r[6], r[0]))
        for bucket, quota in quotas.items():
            queues, n = [[r for r in ranked if r[1] == bucket and r[2:4] == b] for b in sorted(turn, key=turn.get)], 0
            while n < quota and any(queues):
                for q in queues:
                    while q and n < quota:
                        if take(q.pop(0)):
                            n += 1
                            break
        rest = {s: [r for r in ranked if r[8] == s and r[0] not in set(chosen)] for s in range(8)}
        while len(chosen) < sum(quotas.values()) and any(rest.values()):
            s = min((s for s in rest if rest[s]), key=lambda s: (sectors[s], s))
            while rest[s] and not take(rest[s].pop(0)):
                pass
        assert [r.cand_id for r in select.select_separated(c, quotas).orderBy("position").collect()] == chosen


def test_scattered_reaches_its_target(spark):
    xs = {(a, b) for a in range(9) for b in range(9)}
    for target in (7, 36, 60, 81, 100):
        got = [(r.row, r.col) for r in spatial.scattered(cells(spark, xs), target, None, 3).collect()]
        assert len(got) == len(set(got)) == min(target, 81) and set(got) <= xs
