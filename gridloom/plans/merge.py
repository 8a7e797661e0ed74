"""Streamline packages put together, with their summaries merged rather than recomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.values import least_setting
from ..sources.package import combine


def components(segments: list[DataFrame], summaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, statistics by field, thresholds): ``summaries`` has (component, field, min, max, mean,
    streamlines, least_segments, least_cells), one row a component and field; means weigh by streamlines."""
    joined = combine(*segments)
    merged = stats.merged_stats(summaries.withColumnRenamed("streamlines", "weight"), "weight", ["field"]).withColumnRenamed("weight", "streamlines")
    return joined, merged, least_setting(summaries, "least_segments", "least_cells")


def buckets(parts: DataFrame) -> DataFrame:
    """Depth statistics of buckets that several components share; parts (bucket, min, max, mean, weight)."""
    return stats.merged_stats(parts, "weight", ["bucket"])


def sector_totals(parts: DataFrame, counts: str = "sector_counts") -> DataFrame:
    """Counts by sector as one array of eight."""
    got = stats.merged_arrays(parts, counts)
    return got.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "count"))), lambda x: x["count"]).alias(counts))
