"""Cross-site boilerplate lines: a line that stands on many distinct sites is cut from every page.

Lines are known by two 64-bit hashes. A HyperLogLog sketch of the sites of each line is built by aggregation
(partial sketches before the shuffle, merged after it); where the estimate is too near the threshold to
decide, the line's distinct sites are counted exactly. DataFrame functions alone, no Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

MIN_SITES = 10
BLANKS = " \t\r\x0b\x0c"
LG_K = 8  # registers of a sketch: 2 ** LG_K
#: Relative standard error of the sketch, and how many of them around the threshold are counted exactly.
ERROR, SIGMAS = 1.04 / 2 ** (LG_K / 2), 4


def line_key(line: Column) -> Column:
    """Two 64-bit hashes of a line without the blanks at its ends; null for a blank line."""
    t = F.btrim(line, F.lit(BLANKS))
    return F.when(t != "", F.struct(F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("line"), t).alias("h2")))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, site_col: str, text_col: str, min_sites: int) -> DataFrame:
    """(h1, h2): the lines that stand on ``min_sites`` distinct sites or more. A null site counts for none."""
    rows = docs.where(F.col(f"`{site_col}`").isNotNull()).select(
        F.xxhash64(F.col(f"`{site_col}`")).alias("site"), F.explode(F.transform(lines(F.col(f"`{text_col}`")), line_key)).alias("k")
    ).where("k is not null").select("k.h1", "k.h2", "site")
    margin = max(1.0, SIGMAS * ERROR * min_sites)
    spread = durable(
        rows.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"))
        .where(F.col("estimate") >= min_sites - margin))
    sure = spread.where(F.col("estimate") > min_sites + margin).select("h1", "h2")
    near = spread.where(F.col("estimate") <= min_sites + margin).select("h1", "h2")
    # a frequent line's rows are one a site before they are dealt by line
    pairs = rows.groupBy("h1", "h2", "site").agg(F.count("*").alias("n")).join(near, ["h1", "h2"], "left_semi")
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(exact.select("h1", "h2"))


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the texts; same rows and columns, and n_lines, n_removed BIGINT.

    A line is boilerplate if it stands, without the blanks at its ends, on ``min_sites`` distinct sites or more;
    blank lines never are. They are cut from every text that has a line of its own besides; a text that has none, a
    whole copy of a spread page, is left as it is for document-level dedup to judge, as nothing would be left of it.
    Null texts stay null with no lines; an empty text has one blank line; a null site spreads no line; null ids and
    repeated rows stay; very long texts are taken whole; an empty table gives no rows. ``n_chars``, where present,
    follows a changed text. Columns named n_lines, n_removed in the input are replaced; other names never clash, as
    the input's columns are kept apart in one.
    """
    docs = docs.drop("n_lines", "n_removed")
    text = F.col(f"`{text_col}`")
    # rows are known by two hashes of the text: what is cut depends on it alone. The text travels as its lines, so that
    # what is kept can be taken from them in one pass, however many they are.
    others = [c for c in docs.columns if c.lower() != text_col.lower()]
    rows = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in others)).alias("d"), lines(text).alias("xs"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"))
    found = durable(boilerplate(docs, site_col, text_col, min_sites))
    own = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"), F.posexplode(F.transform(lines(text), line_key)).alias("at", "k")).where("k is not null").select("t1", "t2", "at", "k.h1", "k.h2")
    marks = own.join(found, ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("marks"))
    marks = marks.select("t1", "t2", F.concat(F.array(F.lit(-1)), "marks").alias("marks"))
    joined = rows.join(marks, ["t1", "t2"], "left")
    kept = F.flatten(F.transform("marks", lambda m, i: F.slice("xs", m + 2, F.coalesce(F.get("marks", i + 1), F.size("xs")) - m - 1)))
    cut = F.coalesce(F.exists(kept, lambda x: F.btrim(x, F.lit(BLANKS)) != ""), F.lit(False))
    joined = joined.withColumn("kept", F.when(cut, kept))
    changed = F.col("kept").isNotNull()
    put = {c: F.col(f"d.`{c}`") for c in others} | {text_col: F.when(F.col("xs").isNotNull(), F.concat_ws("\n", F.coalesce("kept", "xs")))}
    if "n_chars" in others:
        put["n_chars"] = F.when(changed, F.length(F.concat_ws("\n", "kept")).cast("long")).otherwise(F.col("d.n_chars"))
    return joined.select(
        *(put[c].alias(c) for c in docs.columns),
        F.when(F.col("xs").isNull(), 0).otherwise(F.size("xs")).cast("long").alias("n_lines"),
        F.when(changed, F.size("marks") - 1).otherwise(0).cast("long").alias("n_removed"),
    )
