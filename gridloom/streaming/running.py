"""Summaries that run along while data arrive: the chunked scans of a batch job, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_stats(stream: DataFrame, key: str, value: str, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum, min and max by key; with ``time`` by window too, rows later than ``late`` left out."""
    if time:
        stream = stream.withWatermark(time, late)
        by = [F.window(time, window), F.col(key)]
    else:
        by = [F.col(key)]
    v = F.col(value)
    return stream.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))
