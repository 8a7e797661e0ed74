"""Licence scan with ordered signature rules, in DataFrame expressions alone.

Rows are independent: each text is normalised, gated by keywords, matched against the rules whose keyword it
has, and the detections are resolved in one pass over them sorted by place. No shuffle, no Python workers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SEPARATORS, UPPER
from .license_rules import RULES

#: Confidence of a detection by its rule's priority.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.6}
#: Phrases that always count, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
KIND = "array<struct<start:int,minus_end:int,priority:int,rule:int,label:string>>"


def rules(text: str = RULES) -> list[tuple[str, int, list[str], str]]:
    """(label, priority, keywords, regex) in order."""
    rows = [line.split("|", 3) for line in text.strip().splitlines()]
    return [(label, int(p), keys.split("/"), rx) for label, p, keys, rx in rows]


def normalised(text: Column) -> Column:
    """`` word word word ``: A-Z lower-cased, one blank around every word; a null or wordless text is one blank."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), SEPARATORS, " ")


def blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def spans(norm: Column, regex: Column) -> Column:
    """ARRAY<STRUCT<start, n>>: places of a regex in normalised text, in words from 0.

    The pieces between matches and the matches themselves give the places: words before a match are blanks
    before it, minus the leading one.
    """
    bounded = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    pieces, found = F.split(norm, bounded, -1), F.regexp_extract_all(norm, bounded, F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + blanks(x["piece"])
        inner = blanks(x["match"])
        return F.struct(
            (start + inner).alias("at"),
            F.concat(acc["out"], F.array(F.struct((start - 1).alias("start"), (inner + 1).alias("n")))).alias("out"),
        )

    # arrays_zip would pad the last piece with a null match; slice drops it
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.aggregate(pairs, zero, step)["out"]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's licence detections: doc_id, n_words, detections ARRAY<STRUCT<label, priority, start, end>>,
    n_suppressed, base ARRAY<STRUCT<start, n>>, base_labels, labels ARRAY<STRING>, score.

    Words are digits, a-z (A-Z lower-cased) and non-ASCII characters; places count words from 0, ends exclusive.
    A detection is suppressed if it lies inside one of the same or a better priority (1 is best); of equal
    intervals the better priority, then the earlier rule, stays. ``labels`` has the labels of what stays and of
    the base phrases, distinct and sorted; ``score`` is the confidence of the best detection (0 without any).
    Null, empty and wordless texts have no words and no detections; long texts are scanned whole; null ids and
    repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    table = rules()
    keys = list(dict.fromkeys(k for _, _, ks, _ in table for k in ks))
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    # one pass over the words says which keywords are there; most texts have none and stop here
    gated = norm.withColumn("keys", F.array_intersect(F.array(*map(F.lit, keys)), F.split("norm", " ")))
    literal = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.array(*map(F.lit, ks)).alias("keys"), F.lit(rx).alias("regex")) for k, (label, p, ks, rx) in enumerate(table)))

    def detect(r: Column) -> Column:
        return F.transform(spans(F.col("norm"), r["regex"]), lambda s: F.struct(
            s["start"].alias("start"), (-(s["start"] + s["n"])).alias("minus_end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))

    live = F.filter(literal, lambda r: F.arrays_overlap(F.col("keys"), r["keys"]))
    found = F.when(F.size("keys") > 0, F.array_sort(F.flatten(F.transform(live, detect)))).otherwise(F.array().cast(KIND))
    base_rx = "|".join(BASE)
    has_base = F.contains(F.col("norm"), F.lit("license"))
    base = F.when(has_base, spans(F.col("norm"), F.lit(base_rx))).otherwise(F.array().cast("array<struct<start:int,n:int>>"))
    base_labels = F.array_compact(F.array(*(F.when(has_base & F.contains(F.col("norm"), F.lit(f" {p} ")), F.lit(label)) for p, label in sorted(BASE.items(), key=lambda x: x[1]))))
    levels = sorted(CONFIDENCE)
    zero = F.struct(*(F.lit(-1).alias(f"end{p}") for p in levels), F.array().cast("array<struct<label:string,priority:int,start:int,end:int>>").alias("kept"), F.lit(0).alias("n_suppressed"))

    def resolve(acc: Column, d: Column) -> Column:
        # sorted by start, then longest, best and first rule: whatever contains d came before it
        end = -d["minus_end"]
        reach = F.greatest(*(F.when(d["priority"] >= p, acc[f"end{p}"]).otherwise(-1) for p in levels), F.lit(-1))
        inside = reach >= end
        return F.struct(
            *(F.when(d["priority"] == p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in levels),
            F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.struct(d["label"].alias("label"), d["priority"].alias("priority"), d["start"].alias("start"), end.alias("end"))))).alias("kept"),
            (acc["n_suppressed"] + inside.cast("int")).alias("n_suppressed"),
        )

    out = gated.select("doc_id", (blanks(F.col("norm")) - 1).cast("long").alias("n_words"), F.aggregate(found, zero, resolve).alias("r"), base.alias("base"), base_labels.alias("base_labels"))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("r.kept", lambda d: d["label"]), "base_labels")))
    best = F.array_min(F.transform("r.kept", lambda d: d["priority"]))
    score = reduce(lambda acc, p: acc.when(best == p, F.lit(CONFIDENCE[p])), levels[1:], F.when(best == levels[0], F.lit(CONFIDENCE[levels[0]])))
    return out.select("doc_id", "n_words", F.col("r.kept").alias("detections"), F.col("r.n_suppressed").alias("n_suppressed"), "base", "base_labels", labels.alias("labels"), score.otherwise(F.lit(0.0)).alias("score"))
