"""JSON texts, maps and lists as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright.functions.text import col, is_blank, text


def as_map(c: Column | str) -> Column:
    """The entries of a JSON object as texts; empty for what is none."""
    return F.coalesce(F.from_json(col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_contains(c: Column | str, wanted: dict[str, str]) -> Column:
    """Whether a JSON object has all these entries."""
    held = as_map(c)
    hit = F.lit(True)
    for k, v in wanted.items():
        hit = hit & F.coalesce(F.try_element_at(held, F.lit(k)) == v, F.lit(False))
    return hit


def any_value(c: Column | str, wanted: str) -> Column:
    """Whether some entry of a JSON object has this value."""
    return F.exists(F.map_values(as_map(c)), lambda v: F.coalesce(v == wanted, F.lit(False)))


def as_list(c: Column | str) -> Column:
    """A field of several values: a JSON list, or texts between commas; trimmed, without blanks and repeats, in order."""
    t = text(c)
    parts = F.when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.split(t, ","))).otherwise(F.split(t, ","))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def described(m: Column | str) -> Column:
    """A map as ``key: value | key: value`` by key, without blank values."""
    entries = F.array_sort(F.map_entries(F.map_filter(col(m), lambda k, v: ~is_blank(v))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))), " | ")


def pairs(a: Column | str, b: Column | str) -> Column:
    """Two lists as one of structs (place, first, second), for explode; the shorter one ends in nulls."""
    both = F.arrays_zip(col(a).alias("first"), col(b).alias("second"))
    return F.transform(both, lambda x, i: F.struct((i + 1).alias("place"), x["first"].alias("first"), x["second"].alias("second")))
