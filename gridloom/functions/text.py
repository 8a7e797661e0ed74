"""Attributes, names, times and messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of sub-regions by code, used where a record has none.
REGIONS = {
    "CE": "Central East", "CW": "Central West", "NE": "Northeast", "NO": "North", "NW": "Northwest", "SE": "Southeast", "SW": "Southwest",
}


def decode_attr(text: Column, raw: Column, default: Column | str = "") -> Column:
    """bytes as UTF-8 with replacement characters, else the text, else the default."""
    return F.coalesce(F.make_valid_utf8(raw.cast("string")), text, F.lit(default))


def fill_value(values: Column, fallback: float) -> Column:
    """The first number of an attribute; the fallback for none, an empty one or one that can't be read."""
    return F.coalesce(F.try_element_at(values, F.lit(1)).try_cast("double"), F.lit(float(fallback)))


def flag_dictionary(values: Column, meanings: Column, default: dict[str, str] | None = None) -> Column:
    """MAP of flag values to meanings parted by blanks; pairs as far as both go; the default for none."""
    names = F.filter(F.split(F.trim(meanings), r"\s+"), lambda x: x != "")
    n = F.least(F.size(values), F.size(names))
    pairs = F.map_from_arrays(F.slice(values.cast("array<string>"), F.lit(1), n), F.slice(names, F.lit(1), n))
    other = F.create_map(*(F.lit(x) for kv in (default or {}).items() for x in kv)) if default else F.create_map().cast("map<string,string>")
    return F.when(values.isNotNull() & meanings.isNotNull() & (n > 0), pairs).otherwise(other)


def region_name(name: Column, code: Column, names: dict[str, str] = REGIONS) -> Column:
    """A trimmed name; for a blank one the code's name, or the code."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), known[code], code)


def file_stem(path: Column) -> Column:
    """Lower-cased file name without folders and its last extension."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", ""))


def default_basename(path: Column, prefix: str) -> Column:
    """prefix, model year and "annual" as the file name has them."""
    stem = file_stem(path)
    year = F.regexp_extract(stem, r"yr(\d+)", 1)
    return F.concat(F.lit(prefix), F.when(year != "", F.concat(F.lit("_yr"), year)).otherwise(""), F.when(F.contains(stem, F.lit("annual")), "_annual").otherwise(""))


def output_basename(base: Column, kind: Column) -> Column:
    """the class as a suffix, with its margin run together (margin_50km to margin50km); none for others."""
    named = kind.isin("cavity_margin_50km", "cavity_margin_80km", "remote_open_ocean")
    return F.when(named, F.concat_ws("_", base, F.replace(kind, F.lit("margin_"), F.lit("margin")))).otherwise(base)


def month_stamp(ts: Column) -> Column:
    """F4."""
    return F.date_format(ts, "yyyyMM")


def time_label(path: Column, iso: Column) -> Column:
    """"Year N annual mean" where the name says so, else the instant."""
    year = F.regexp_extract(path, r"yr(\d+)", 1)
    return F.when((year != "") & F.contains(F.lower(path), F.lit("annual")), F.concat(F.lit("Year "), year, F.lit(" annual mean"))).otherwise(iso)


def iso_instant(seconds: Column) -> Column:
    """unix seconds to ISO 8601, UTC (with the session in UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def model_time(value: Column, units: Column) -> Column:
    """"<unit> since <instant>" in the proleptic Gregorian calendar, as a TIMESTAMP; NULL for other units."""
    unit, origin = F.lower(F.regexp_extract(units, r"^\s*(\w+?)s?\s+since", 1)), F.regexp_extract(units, r"since\s+(.+?)\s*$", 1)
    size = F.create_map(*(F.lit(x) for kv in (("second", 1.0), ("minute", 60.0), ("hour", 3600.0), ("day", 86400.0)) for x in kv))
    return F.timestamp_seconds(F.unix_timestamp(F.try_to_timestamp(F.replace(origin, F.lit("T"), F.lit(" ")))) + value * size[unit])


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of milliseconds; negative ones are 0."""
    t = F.greatest(F.lit(0), F.floor(ms + 0.5)).cast("long")
    part = lambda by, of: (F.floor(t / by) % of).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), t % 1000)


def ease(t: Column, kind: Column) -> Column:
    """progress under an easing; linear unless named."""
    return (F.when(kind == "easeInOutCubic", F.when(t < 0.5, 4 * t * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(3.0)) / 2))
            .when(kind == "easeInOutQuad", F.when(t < 0.5, 2 * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(2.0)) / 2))
            .when(kind == "easeOutCubic", 1 - F.pow(1 - t, F.lit(3.0))).otherwise(t))


def between_poses(a: Column, b: Column, t: Column) -> Column:
    """arrays blended element by element."""
    return F.zip_with(a, b, lambda x, y: x + (y - x) * t)


def base_url(url: Column) -> Column:
    """without slashes at its end."""
    return F.regexp_replace(url, "/+$", "")


def with_query(url: Column, *pairs: tuple[str, Column]) -> Column:
    """base URL and the parameters that aren't null."""
    return F.concat(base_url(url), F.lit("/?"), F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in pairs)))


def locale(tag: Column) -> Column:
    """zh-CN or en-US for a tag in their usual spellings; en-US for any other and for none."""
    t = F.replace(F.lower(F.trim(F.coalesce(tag, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(t.isin("zh", "zh-cn"), "zh-CN").otherwise("en-US")


def message(document: Column, path: str) -> Column:
    """a message of a JSON catalogue by dotted path."""
    return F.get_json_object(document, "$." + path)


def filled(template: Column, **tokens: Column) -> Column:
    """{token} replaced by its value; tokens without one go."""
    for k, v in tokens.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return F.regexp_replace(template, r"\{\w+\}", "")


def route(path: Column) -> Column:
    """a path without its last slash; the root for none."""
    return F.when(F.coalesce(path, F.lit("")).isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))


def localized_number(v: Column, decimals: int = 0) -> Column:
    """with thousands separators."""
    return F.format_number(v, decimals)


def subtitle(number: Column, start: Column, duration: Column, words: Column) -> Column:
    """One numbered subtitle block."""
    return F.concat(number.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(start + duration), F.lit("\n"), F.trim(words), F.lit("\n"))


def preview_entry(grid: dict[str, Column], counts: Column, ranges: Column) -> Column:
    """A preview's index record as JSON: grid, class counts and display ranges."""
    return F.to_json(F.struct(F.struct(*(v.alias(k) for k, v in grid.items())).alias("grid"), F.struct(counts.alias("counts")).alias("mask"), ranges.alias("variables")))
