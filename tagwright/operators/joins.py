"""Lookups and joins. No side is broadcast by hint but where it is a configured list: Spark compares sizes at run time and splits skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.coerce import number
from tagwright.functions.text import text


def join_key(c: str) -> Column:
    """A key as text: no ``.0`` of a number read as a decimal, missing-value texts empty. Empty keys meet each other."""
    t = F.regexp_replace(text(c), r"\.0$", "")
    return F.when(F.lower(t).isin("nan", "none", "nat"), "").otherwise(t)


def repeated_keys(right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: what a many-to-one lookup must not have."""
    return right.groupBy(*[join_key(k).alias(k) for k in keys]).agg(F.count("*").alias("n")).where("n > 1")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_r", many_to_one: bool = False) -> DataFrame:
    """Left join on cleaned keys; columns of both sides stay, the right's with ``suffix``. With ``many_to_one`` repeated keys fail the query."""
    if many_to_one:
        others = [c for c in right.columns if c not in keys]
        one = right.groupBy(*[join_key(k).alias(k) for k in keys]).agg(F.count("*").alias("_n"), F.any_value(F.struct(*others)).alias("_row"))
        once = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"keys repeat: {keys}"))).otherwise(F.col("_row"))
        right = one.withColumn("_row", once).select(*keys, "_row.*")
    named = right.select(*[join_key(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c not in keys])
    on = [join_key(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return left.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def collapsed_lookup(left: DataFrame, right: DataFrame, keys: list[str], additive: list[str], order: str) -> DataFrame:
    """What ``tables.collapse`` makes of a ``lookup``, without the rows that this fans out: both sides are brought to one row a key before they meet.

    ``additive`` and ``order`` are columns of the right side, which has none of the left one's but ``keys``. A sum counts once for each
    left row of its key; of left columns the least value is the first, since all of a key's left rows meet the same right rows.
    """
    kinds, others = dict(right.dtypes), [c for c in right.columns if c not in (*keys, *additive)]
    value = lambda c: number(c) if kinds[c] == "string" else F.col(c)
    first = lambda c: F.min(c) if c == order else F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c)))
    lines = right.groupBy(*[join_key(k).alias(k) for k in keys]).agg(*[F.sum(value(c)).alias(c) for c in additive], *[first(c).alias(c) for c in others])
    own = [c for c in left.columns if c not in keys]
    one = left.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.min(c).alias(c) for c in own])
    met = lookup(one, lines, keys)
    return met.select(*keys, *[(F.col(c) * F.col("_rows")).alias(c) for c in additive], *own, *others)


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key, the smallest on ties. Counts are combined before rows move."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value), F.max("_n").alias("n"))


def known(left: DataFrame, right: DataFrame, key: str, other: str, out: str) -> DataFrame:
    """``left`` with whether its key is among the other table's."""
    ids = right.select(F.col(other).alias("_id")).where("_id is not null").distinct()
    return left.join(ids, left[key] == F.col("_id"), "left").withColumn(out, F.col("_id").isNotNull()).drop("_id")


def orphans(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    return left.join(right.select(F.col(other).alias(key)), key, "left_anti")


def with_mapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` through ``mapping`` (old, new); values without an entry stay."""
    one = mapping.groupBy("old").agg(F.min("new").alias("new"))
    return df.join(one, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def first_candidate(df: DataFrame, key: str, candidates: Column, assets: DataFrame, asset: str) -> DataFrame:
    """Each row's first candidate that is an asset: key, asset, place. ``candidates`` is an array of texts."""
    found = df.select(key, F.posexplode(candidates).alias("place", asset)).join(assets.select(asset).distinct(), asset)
    return found.groupBy(key).agg(F.min_by(asset, "place").alias(asset), F.min("place").alias("place"))


def permission_matrix(users: DataFrame, features: DataFrame, grants: DataFrame) -> DataFrame:
    """Every user with an array of whether each feature is granted, by feature. ``users`` (user), ``features`` (feature: a configured list), ``grants`` (user, feature)."""
    cells = users.join(F.broadcast(features)).join(grants.distinct().withColumn("_granted", F.lit(True)), ["user", "feature"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("feature", F.coalesce("_granted", F.lit(False)).alias("granted"))))
    return cells.groupBy("user").agg(F.transform(ordered, lambda x: x["granted"]).alias("granted"))


def instrument_parent(instruments: DataFrame, equipment: DataFrame) -> DataFrame:
    """Each instrument (tag, area) with the shortest tag of its area, ties by tag."""
    best = equipment.groupBy("area").agg(F.min_by("tag", F.struct(F.length("tag"), F.col("tag"))).alias("parent"))
    return instruments.join(best, "area", "left")


def per_parent(edges: DataFrame, most: int) -> DataFrame:
    """Fair sample of edges (parent, child): the first children of every parent before the second ones."""
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("child"))
    return edges.withColumn("rank", rank).orderBy("rank", "parent").limit(most)


def index_to_tag(df: DataFrame, ref: str, table: DataFrame, place: str, tag: str) -> DataFrame:
    """``ref`` with the tag of the row whose place (from 0) it gives as a number; other texts, and places that no row has, stay."""
    names = table.select(F.col(place).cast("string").alias("_place"), F.col(tag).alias("_tag"))
    return df.join(names, F.when(text(ref).rlike("^[0-9]+$"), text(ref)) == F.col("_place"), "left").withColumn(ref, F.coalesce("_tag", ref)).drop("_place", "_tag")
