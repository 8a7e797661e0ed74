"""Values of several columns, maps and records put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stacked(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """The values of several columns as one: each row gives one row a column, without a union's rescans."""
    return df.select(F.explode(F.array(*columns)).alias(out))


def merged_maps(*maps: Column) -> Column:
    """Maps put together; of equal keys the last map's value stays."""
    def put(a: Column, b: Column) -> Column:
        a, b = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (a, b))
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return reduce(put, maps)


def layered(*states: Column) -> Column:
    """The first of the states, from the most particular one on, that has a value."""
    return F.coalesce(*reversed(states))


def least_setting(configs: DataFrame, *columns: str) -> DataFrame:
    """One row with the least of each setting over all records."""
    return configs.agg(*(F.min(c).alias(c) for c in columns))
