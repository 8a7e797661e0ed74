"""Every query with SQL against DuckDB on the smallest tables; the stream against its batch form."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(res.description)}
    assert sorted(at) == cols
    assert got == sorted(repr([plain(r[at[c]]) for c in cols]) for r in res.fetchall())


def test_depth_choice_weighs_draws_as_its_sql(spark, tmp_path):
    nan = float("nan")
    rows = [
        (1, 7, "view", 209.45), (70_000, 7, "view", 209.48),  # the later one is faster, by less than its draws cost
        (2, 8, "view", 209.45), (20_000, 8, "view", 209.48),  # and by more
        (3, 9, None, 5.0), (4, 9, "view", 4.0), (5, 9, "error", 6.0),  # no type is no error
        (6, 10, "error", 1.0), (7, 10, "view", None),  # none valid
        (8, None, "view", 1.0), (9, None, "view", 2.0),
        (None, 11, "view", 3.0), (None, 12, "view", 3.0), (10, 12, "view", 2.0),  # no draw
        (11, 13, "view", nan), (12, 13, "view", 2.0),
        (13, 14, "view", -1.0), (-14, 14, "view", -1.0),
    ]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = entry.queries()["seed_depth_choice"](spark, str(tmp_path))
    got = sorted(repr(plain((r.user_id, r.depth, r.speed))) for r in df.collect())
    assert got == sorted(repr(plain(r)) for r in con.execute(entry.oracle_sql()["seed_depth_choice"]).fetchall())
    assert repr((7, 209.45, 209.48)) in got and repr((8, 209.48, 209.48)) in got and repr((9, 5.0, 5.0)) in got


def test_fastest_depth(spark):
    from gridloom.operators import trace

    rows = [(1, 0, 50.0, 0.2, False), (1, 1, 60.0, 0.3, False), (1, 2, 70.0, 0.3, False), (1, 3, 80.0, None, False), (1, 4, 90.0, 0.9, True)]
    c = spark.createDataFrame(rows, "seed_id long, draw long, depth double, speed double, proxy boolean")
    assert [tuple(r) for r in trace.chosen_depth(c, "seed_id", "fastest_valid").collect()] == [(1, 60.0, 0.3, 0.3)]
    assert [tuple(r) for r in trace.chosen_depth(c, "seed_id", "fastest_valid", merit=-c.draw).collect()] == [(1, 50.0, 0.2, 0.3)]
    assert [tuple(r) for r in trace.chosen_depth(c, "seed_id", "fastest_valid", merit=c.speed * 0).collect()] == [(1, 50.0, 0.2, 0.3)]
    with pytest.raises(ValueError, match="merit"):
        trace.chosen_depth(c, "seed_id", "first_valid", merit=c.speed)


def test_entry(spark):
    assert entry.entry(spark).count() == 3000


def test_running_stats(spark, tmp_path):
    from gridloom.streaming.running import running_stats

    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_stats(stream, "event_type", "value").writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_type: (r.n, round(r.total, 4)) for r in spark.table("running").collect()}
    want = {r.event_type: (r.n, round(r.total, 4)) for r in running_stats(batch, "event_type", "value").collect()}
    assert got == want
