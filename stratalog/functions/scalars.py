"""Numbers, arrays, maps, JSON, hashes and ids as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def slideshow_seconds(value: Column, low: int = 2, high: int = 30, default: int = 5) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(clamp(F.round(value), low, high).cast("int"))


def average(total: Column, n: Column, digits: int = 0) -> Column:
    """Rounded half up; 0 without rows."""
    return F.coalesce(F.round(F.try_divide(total, n), digits), F.lit(0.0))


def image_boost(text_length: Column, images: Column, short: int = 600, cap: float = 0.25) -> Column:
    """Weight added to images for short texts and for many images, capped."""
    lack = F.greatest(1 - text_length / F.lit(float(short)), F.lit(0.0)) * 0.15
    return F.least(lack + F.log1p(images.cast("double")) * 0.03, F.lit(cap))


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def spread(value: Column, factor: float, center: float = 0.5) -> Column:
    return clamp((value - center) * factor + center, 0.0, 1.0)


def columns_for_width(width: Column) -> Column:
    return F.when(width >= 1024, 5).when(width >= 768, 4).otherwise(2)


def batch_cost(tokens: Column, price_per_million: float, rows: Column) -> Column:
    return tokens * F.lit(price_per_million / 1e6) / rows


def tag_list(value: Column) -> Column:
    """`a, b;c` to a sorted array without repeats."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(value, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")))


def numeric_entries(values: Column) -> Column:
    """Entries of a string map whose values are numbers."""
    return F.map_filter(F.transform_values(values, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())


def top_entries(values: Column, k: int = 5) -> Column:
    """The ``k`` entries of the highest values, ties by key."""
    ranked = F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: F.struct(e["key"].alias("key"), (-e["minus"]).alias("value")))


def ordered_union(*arrays: Column) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(F.concat(*arrays))


def loose_json(text: Column, schema: str) -> Column:
    """JSON as such, in a fence, or between the outermost brackets."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    sliced = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    parsed = lambda c: F.from_json(F.when(F.try_parse_json(c).isNotNull(), c), schema)
    return F.coalesce(parsed(text), parsed(fenced), parsed(sliced))


def canonical_json(value: Column) -> Column:
    """Compact JSON with sorted keys of a JSON text; null if it is none."""
    return F.to_json(F.try_parse_json(value))


def digest(value: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text."""
    return F.sha2(canonical_json(value), 256)


def holdout(key: Column, modulus: int = 5) -> Column:
    """Split by the first 8 hex digits of the key's SHA-256."""
    part = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long")
    return F.when(part % modulus == 0, "holdout").otherwise("development")


def image_id(post: Column, index: Column, src: Column) -> Column:
    joined = F.concat(post.cast("string"), F.lit(":"), index.cast("string"), F.lit(":"), src)
    return F.concat(F.lit("img-"), F.substring(F.sha1(joined), 1, 16))


def fallback_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def string_seed(value: Column, base: int = 31, modulus: int = 9973) -> Column:
    """Polynomial hash of a string's characters."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda s, c: (s * base + F.ascii(c)) % modulus)


def scoped_key(row: Column, tag: Column) -> Column:
    return F.concat(F.lit("r"), row.cast("string"), F.lit("__"), tag)


def split_scoped_key(key: Column) -> Column:
    return F.struct(F.regexp_extract(key, r"^r(\d+)__", 1).try_cast("int").alias("row"), F.regexp_extract(key, r"^r\d+__(.*)$", 1).alias("tag"))


def cell_text(value: Column, limit: int = 120) -> Column:
    text = F.to_json(F.struct(value.alias("v")))
    text = F.regexp_replace(F.regexp_replace(text, r'^\{"v":(.*)\}$', "$1"), r'^"(.*)"$', "$1")
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)
