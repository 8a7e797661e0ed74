"""What several corpus operators share: durable tables, bounded batches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import durable, ship  # noqa: F401

#: Upper-case to lower-case for A-Z alone and every separator to a blank: one C-level pass gives the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of UTF-8 text.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: The same words in Spark SQL, after ``ascii_lower``.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of digits, a-z and non-ASCII bytes; null has none."""
    return text.encode().translate(WORD_TABLE).split() if text else []


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
    release()


def release() -> None:
    """Gives free memory back to the system: workers are kept for later tasks, and what they hold adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


EDGES = 1 << 12  # edges a task is worth starting for, in the rounds of connected components


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Alternating large-star and small-star rounds; each is one minimum per node (map-side combined) and
    one equi-join, so no node's neighbours are gathered anywhere. Edges of the round are checkpointed; its exchanges
    are written by as many tasks as they are worth, since every task leaves files of its own at every exchange.
    Null ends are ignored; an edge from a node to itself yields no row. Empty input gives no rows.
    """
    def clean(df: DataFrame) -> DataFrame:
        u, v = F.greatest("u", "v"), F.least("u", "v")
        return df.where("u is not null and v is not null and u <> v").select(u.alias("u"), v.alias("v")).distinct()

    tasks = 1 << 30
    cur, mark = durable(clean(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))), None
    while True:
        now = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark or now[0] == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = now
        tasks = min(tasks, now[0] // EDGES + 1)
        cur = cur.coalesce(tasks)
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = clean(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = durable(clean(small.union(least.select("u", F.col("m").alias("v")))).coalesce(tasks))
