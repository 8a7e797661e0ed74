"""What holds for any input."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import validity
from gridloom.operators import polyline, select, stats

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@FEW
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True), min_size=1, max_size=40), st.sampled_from([0.5, 1.0, 25.0]))
def test_quantised_values_come_back(spark, xs, scale):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    for x, q, back in df.select("v", validity.quantize(F.col("v"), scale), validity.dequantize(validity.quantize(F.col("v"), scale), scale)).collect():
        assert -32768 <= q <= 32767 and (q == -32768) == (not math.isfinite(x)) == (back is None)
        if back is not None and abs(x) <= 32767 * scale:
            assert abs(back - x) <= scale / 2 + 1e-9 * abs(x)


@FEW
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12), st.integers(0, 400))
def test_quotas_add_up(spark, weights, total):
    df = spark.createDataFrame([(k, float(w)) for k, w in enumerate(weights)], "idx int, weight double")
    got = {r.idx: r.slots for r in select.weighted_targets(df, total).collect()}
    assert sum(got.values()) == (total if any(weights) else 0)
    assert all(got[k] == 0 for k, w in enumerate(weights) if not w)
    if any(weights):
        parts = spark.createDataFrame([(k, w / sum(weights)) for k, w in enumerate(weights)], "idx int, fraction double")
        assert abs(sum(r.slots for r in select.bucket_targets(parts, total).collect()) - total) <= 1


@FEW
@given(st.dictionaries(st.integers(0, 10_000), st.integers(-9, 9), min_size=1, max_size=60), st.sampled_from([2, 16, 4096]))
def test_running_sums(spark, rows, block):
    df = spark.createDataFrame(sorted(rows.items()), "o long, n long")
    got = {r.o: r.s for r in polyline.exclusive_sum(df, "o", "n", "s", block=block).collect()}
    assert got == {k: sum(v for j, v in rows.items() if j < k) for k in rows}


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(-1e6, 1e6)), min_size=1, max_size=50))
def test_merged_summaries(spark, rows):
    df = spark.createDataFrame(rows, "k int, v double")
    parts = df.groupBy("k").agg(*stats.stats(F.col("v")), F.count("v").alias("w"))
    a, b = stats.merged_stats(parts, "w").first(), df.agg(*stats.stats(F.col("v"))).first()
    assert a["min"] == b["min"] and a["max"] == b["max"] and math.isclose(a["mean"], b["mean"], rel_tol=1e-9, abs_tol=1e-6)
