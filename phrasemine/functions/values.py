"""Column functions on plain values: text, hashes, numbers, times, lists, maps, JSON and missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column, kind: str = "string") -> Column:
    """Whether a value counts as missing: null, an empty string, or zero."""
    return c.isNull() | (c == (F.lit("") if kind == "string" else F.lit(0)))


def or_else(c: Column, default: Column, kind: str = "string") -> Column:
    """The value, or a default where it counts as missing."""
    return F.when(missing(c, kind), default).otherwise(c)


def first_words(c: Column, n: int) -> Column:
    """The first n words between white space, joined by one space."""
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, n), " ")


def find_all(c: Column, pattern: str) -> Column:
    """All matches of a pattern, whatever their case, in order."""
    return F.regexp_extract_all(c, F.lit(f"(?i){pattern}"), F.lit(0))


def short_md5(c: Column, n: int = 8) -> Column:
    """The first n hex digits of the digest of a text's UTF-8 bytes."""
    return F.substring(F.md5(c), 1, n)


def clamp(c: Column, low: float, high: float) -> Column:
    """X4."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def edge_weight(distance: Column) -> Column:
    """exp(-d^2), the weight of an edge under a metric that is not cosine."""
    return F.exp(-distance * distance)


def iso_text(c: Column) -> Column:
    """A UTC time as ISO text of whole seconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def batch_id(c: Column, prefix: str = "batch") -> Column:
    """The name of a batch that starts at a time."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(c, "yyyyMMdd_HHmmss"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two times."""
    return F.timestamp_diff("SECOND", start, end)


def in_order(c: Column) -> Column:
    """A list without repeats and nulls, first places kept."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull()))


def merged(a: Column, b: Column) -> Column:
    """Two maps in one; the second one's values win."""
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(kept, b)


def get_or(m: Column, key: Column, default: Column) -> Column:
    """A map's value, or a default."""
    return F.coalesce(F.try_element_at(m, key), default)


def keys_by_value(m: Column) -> Column:
    """A map's keys by value, largest first, then by key."""
    order = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.transform(order, lambda e: e["k"])


def json_list(c: Column, kind: str = "long") -> Column:
    """The list in a JSON text, empty where there is none."""
    return F.coalesce(F.from_json(c, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def json_append(c: Column, value: Column, kind: str = "long") -> Column:
    """The JSON text of a list with one value more, unless it is there."""
    items = json_list(c, kind)
    return F.to_json(F.when(F.array_contains(items, value), items).otherwise(F.array_append(items, value)))
