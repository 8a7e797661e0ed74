"""Self-describing packages: packed little-endian fields in a .bin and their description in a .meta.json."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.polyline import exclusive_sum

KINDS = {"int16": "<i2", "uint8": "u1", "uint16": "<u2", "int32": "<i4", "float32": "<f4"}
META = """title string, product_version string, source_file string, geometry_type string,
 grid struct<nx:int,ny:int,x0_m:double,y0_m:double,dx_m:double,dy_m:double>, quantization map<string,string>,
 fields array<struct<name:string,dtype:string,byte_offset:bigint,byte_length:bigint,unit:string,scale:double,offset:double,fill_value:int>>"""


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: base name, raw JSON and the parsed parts."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    base = F.regexp_replace("path", r"\.meta\.json$", "")
    return raw.select(base.alias("base"), "raw", F.from_json("raw", META).alias("m")).select("base", "raw", "m.*")


def read_fields(spark: SparkSession, bins: str, metas: DataFrame) -> DataFrame:
    """(base, name, i, raw DOUBLE): every element of every field, in order.

    Binaries meet their descriptions by base name; offsets need no alignment. Bytes are decoded in the workers,
    one field at a time.
    """
    files = spark.read.format("binaryFile").load(bins).select(F.regexp_replace("path", r"\.bin$", "").alias("base"), "content")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = files.withColumn("base", plain("base")).join(metas.select(plain("base").alias("base"), F.explode("fields").alias("f")), "base")
    slices = both.select("base", "f.name", "f.dtype", F.substring(F.col("content"), (F.col("f.byte_offset") + 1).cast("int"), F.col("f.byte_length").cast("int")).alias("b"), F.col("f.byte_length").alias("n"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                if r.dtype not in KINDS or len(r.b) != r.n:
                    raise ValueError(f"field {r.name} of {r.base}: unknown type or too few bytes")
                v = np.frombuffer(r.b, KINDS[r.dtype]).astype(np.float64)
                for k in range(0, len(v), 1 << 16):
                    part = v[k:k + (1 << 16)]
                    yield pd.DataFrame({"base": r.base, "name": r.name, "i": np.arange(k, k + len(part)), "raw": part})

    return slices.mapInPandas(run, "base string, name string, i long, raw double")


def layout(fields: DataFrame) -> DataFrame:
    """Fields (position, name, byte_length) with their byte_offset."""
    return exclusive_sum(fields, "position", "byte_length", "byte_offset")


def write(table: DataFrame, order: str, fields: list[tuple[str, str]], base: str, description: dict) -> dict:
    """Writes base.bin and base.meta.json of (column, dtype) fields of a table in ``order``; gives the
    description. A package is one file by definition; rows stream through the driver in order, field by field."""
    at, listed = 0, []
    with open(f"{base}.bin", "wb") as out:
        for name, kind in fields:
            n = 0
            rows = table.select(order, name).orderBy(order).toLocalIterator()
            block: list = []
            for r in rows:
                block.append(r[1])
                if len(block) == 1 << 16:
                    n += out.write(np.array(block, KINDS[kind]).tobytes())
                    block.clear()
            n += out.write(np.array(block, KINDS[kind]).tobytes()) if block else 0
            listed.append({"name": name, "dtype": kind, "byte_offset": at, "byte_length": n})
            at += n
    full = description | {"fields": [f | next((x for x in description.get("fields", []) if x.get("name") == f["name"]), {}) for f in listed]}
    with open(f"{base}.meta.json", "w", encoding="utf-8") as out:
        json.dump(full, out, indent=2)
    return full


def problems(metas: DataFrame) -> DataFrame:
    """(base, problem): what is wrong with each description; no rows if all are sound."""
    f = F.col("fields")
    by = F.array_sort(F.transform(f, lambda x: F.struct(x["byte_offset"].alias("a"), (x["byte_offset"] + x["byte_length"]).alias("b"))))
    overlap = F.exists(F.zip_with(F.slice(by, F.lit(1), F.greatest(F.size(by) - 1, F.lit(0))), F.slice(by, F.lit(2), F.greatest(F.size(by) - 1, F.lit(0))), lambda p, q: q["a"] < p["b"]), lambda x: x)
    width = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, np.dtype(v).itemsize)))
    cells = F.col("grid.nx").cast("long") * F.col("grid.ny")
    lines = F.coalesce(F.col("geometry_type") == "streamlines_3d", F.lit(False))
    whole = F.exists(f, lambda x: x["byte_length"] == cells * width[x["dtype"]])
    parts = F.exists(f, lambda x: x["name"].rlike("channel|segment"))
    tests = {
        "no object": F.col("fields").isNull() & F.col("title").isNull() & F.col("grid").isNull(),
        "no fields": F.coalesce(F.size(f), F.lit(0)) <= 0,
        "no grid": F.col("grid").isNull() & ~lines,
        "size": ((F.col("grid.nx") <= 0) | (F.col("grid.ny") <= 0)) & ~lines,
        "name": F.exists(f, lambda x: x["name"].isNull()),
        "dtype": F.exists(f, lambda x: ~F.coalesce(x["dtype"].isin("int16", "uint8", "uint16", "float32"), F.lit(False))),
        "length": F.exists(f, lambda x: F.coalesce(x["byte_length"], F.lit(0)) <= 0),
        "title": F.coalesce("title", "product_version").isNull(),
        "overlap": overlap,
        "cells": ~lines & ~parts & ~whole,
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items())))
    return metas.select("base", F.explode(found).alias("problem"))


def combine(*parts: DataFrame) -> DataFrame:
    """Tables of one layout, two at least, one after the other."""
    if len(parts) < 2:
        raise ValueError("two components at least")
    if len({tuple(p.dtypes) for p in parts}) > 1:
        raise ValueError("the components' layouts differ")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a folder, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def missing(files: DataFrame, required: DataFrame) -> DataFrame:
    """Required entries that no path ends in."""
    return required.join(files, F.endswith(files["path"], required["entry"]), "left_anti")


def colour_table(spark: SparkSession, path: str) -> DataFrame:
    """(i, r, g, b) of an RGB table; whole numbers of 0-255 are scaled to 0-1."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("at"))
    nums = lines.select("at", F.transform("p", lambda x: x.try_cast("double")).alias("p")).where((F.size("p") == 3) & ~F.exists("p", lambda x: x.isNull()))
    top = nums.agg(F.max(F.greatest(*(F.get("p", F.lit(k)) for k in range(3)))).alias("top"))
    scaled = nums.crossJoin(F.broadcast(top)).select("at", F.when(F.col("top") > 1, F.transform("p", lambda x: x / 255)).otherwise(F.col("p")).alias("p"))
    from pyspark.sql import Window
    i = F.row_number().over(Window.orderBy("at")) - 1  # a colour table has 256 rows
    return scaled.select(i.alias("i"), *(F.get("p", F.lit(k)).alias(c) for k, c in enumerate("rgb")))


def scenes(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """The scenes of a JSON document, one or all; an error if there is none."""
    doc = spark.read.json(path, multiLine=True)
    kind = dict(doc.dtypes).get("scenes", "")
    out = doc.select(F.explode("scenes").alias("s")).select("s.*") if kind.startswith("array") else doc
    out = out.where(F.col("id") == wanted) if wanted else out
    if not out.take(1):
        raise ValueError("no such scene")
    return out
