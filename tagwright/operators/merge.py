"""Repeated uploads: new rows over stored ones. Each takes and returns DataFrames; ``sources.tables.replace`` makes the result the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.functions.text import composite_key, is_blank
from tagwright.operators.tables import keep_first, keep_last, last_non_blank


def _blank(df: DataFrame, c: str):
    return is_blank(c) if dict(df.dtypes)[c] == "string" else F.col(c).isNull()


def merge_on_write(new: DataFrame, old: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows, their blanks filled from the stored row of the key (the first by ``order``), and all stored rows without a new one."""
    old1 = keep_first(old.withColumn("_k", composite_key(*keys)), ["_k"], [order])
    fill = old1.select("_k", F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
    joined = new.withColumn("_k", composite_key(*keys)).join(fill, "_k", "left")
    merged = joined.select(*[F.when(_blank(new, c), F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) if c not in keys and c in old.columns else F.col(c) for c in new.columns])
    rest = old.withColumn("_k", composite_key(*keys)).join(new.select(composite_key(*keys).alias("_k")), "_k", "left_anti").drop("_k")
    return merged.unionByName(rest, allowMissingColumns=True)


def coalesce_upsert(new: DataFrame, old: DataFrame, keys: list[str], always: list[str] = ()) -> DataFrame:
    """All rows with ``outcome`` (inserted, updated, unchanged, kept): nulls of a new row never erase, but ``always`` columns take it as it is."""
    payload = [c for c in old.columns if c not in keys]
    n, o = new.select(*keys, F.struct(*payload).alias("_new")), old.select(*keys, F.struct(*payload).alias("_old"))
    both = n.join(o, keys, "full")
    value = lambda c: F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}") if c in always else F.coalesce(f"_new.{c}", f"_old.{c}"))
    out = both.select(*keys, "_new", "_old", *[value(c).alias(c) for c in payload])
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    outcome = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return out.withColumn("outcome", outcome).drop("_new", "_old")


def guarded_upsert(new: DataFrame, old: DataFrame, keys: list[str], edited: str = "edited_by") -> DataFrame:
    """As ``coalesce_upsert``, but a stored row that a person edited stays as it is."""
    held = old.where(F.col(edited).isNotNull())
    return coalesce_upsert(new.join(held.select(*keys), keys, "left_anti"), old, keys)


def replace_by_key(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key a new row has go, all new rows come."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_by_file(new: DataFrame, old: DataFrame, file: str, created: str, scope: list[str] = ()) -> DataFrame:
    """``replace_by_key`` on the file, or on the file and the ``scope`` columns; a file keeps its earliest time of creation."""
    first = old.groupBy(file).agg(F.min(created).alias("_first"))
    carried = new.join(first, file, "left").withColumn(created, F.coalesce("_first", created)).drop("_first")
    return replace_by_key(carried.select(*new.columns), old, [file, *scope])


def version_conflicts(new: DataFrame, old: DataFrame, keys: list[str], version: str = "row_version") -> DataFrame:
    """Rows whose version is not the stored one."""
    stored = old.select(*keys, F.col(version).alias("stored_version"))
    return new.join(stored, keys).where(~F.col(version).eqNullSafe(F.col("stored_version"))).select(*keys, version, "stored_version")


def merge_properties(new: DataFrame, old: DataFrame, key: str, properties: str = "properties", lineage: str = "lineage", ui: str = "ui_update") -> DataFrame:
    """Map columns merged, new entries over old, but never over a property whose lineage is a person's."""
    n = new.select(key, F.col(properties).alias("_np"), F.col(lineage).alias("_nl"))
    both = old.join(n, key, "full")
    empty = F.create_map().cast("map<string,string>")
    held = F.coalesce(F.col(lineage), empty)
    free = lambda m: F.map_filter(F.coalesce(m, empty), lambda k, v: F.coalesce(F.try_element_at(held, k) != ui, F.lit(True)))

    def over(old_map, new_map):
        kept = F.map_filter(F.coalesce(old_map, empty), lambda k, v: ~F.map_contains_key(new_map, k))
        return F.map_concat(kept, new_map)

    return both.select(key, over(F.col(properties), free(F.col("_np"))).alias(properties), over(F.col(lineage), free(F.col("_nl"))).alias(lineage))


def insert_deduped(new: DataFrame, old: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A batch into a stored table: of its rows with one key each column's last value that is not blank, over the stored row's."""
    one = last_non_blank(new, keys, order, [c for c in old.columns if c not in keys])
    return coalesce_upsert(one, old, keys)


def bulk_upsert(new: DataFrame, old: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The batch's last row of each key in place of the stored one, in all columns."""
    return replace_by_key(keep_last(new, keys, [order]).select(*old.columns), old, keys)


def delete_rows(old: DataFrame, asked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the keys asked for that no row has."""
    return old.join(asked.select(*keys), keys, "left_anti"), asked.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")


def replace_strictly(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """``replace_by_key`` of rows that all have an id of their own: a blank or repeated one fails the query."""
    n = new.groupBy(key).agg(F.count("*").alias("_n"))
    bad = F.when(is_blank(key), F.raise_error(F.lit("a row without an id"))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col(key).cast("string")))).otherwise(F.col(key))
    checked = new.join(n, new[key].eqNullSafe(n[key]), "left").drop(n[key]).withColumn(key, bad).drop("_n")
    return replace_by_key(checked.select(*new.columns), old, [key])


def document_upsert(new: DataFrame, old: DataFrame, keys: list[str], payload: list[str], edited: str = "edited_by", version: str = "row_version") -> DataFrame:
    """All rows with ``outcome``: a stored row takes the new payload, and one version more, only where some value differs and no
    person edited it (the new row's own editor may)."""
    n = new.select(*keys, F.struct(*payload, edited).alias("_new"))
    both = n.join(old.select(*keys, F.struct(*payload, edited, version).alias("_old")), keys, "full")
    differs = F.lit(False)
    for c in payload:
        differs = differs | ~F.col(f"_new.{c}").eqNullSafe(F.col(f"_old.{c}"))
    free = F.col(f"_old.{edited}").isNull() | F.col(f"_new.{edited}").isNotNull()
    outcome = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(differs & free, "updated").otherwise("unchanged")
    both = both.withColumn("outcome", outcome)
    taken = F.col("outcome").isin("inserted", "updated")
    value = [F.when(taken, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in [*payload, edited]]
    count = F.when(F.col("outcome") == "inserted", 1).when(F.col("outcome") == "updated", F.col(f"_old.{version}") + 1).otherwise(F.col(f"_old.{version}"))
    return both.select(*keys, *value, count.alias(version), "outcome")


def replace_label(new: DataFrame, old: DataFrame, label: str, value: str, keys: list[str], order: str) -> DataFrame:
    """A materialised view with the rows of one label computed anew, the last of each key."""
    fresh = keep_last(new.where(F.col(label) == value), [label, *keys], [order])
    return old.where(~F.col(label).eqNullSafe(F.lit(value))).unionByName(fresh.select(*old.columns))


def duplicate_verdicts(new: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """file_uid, duplicate_of, matched_on, is_duplicate of uploaded files (file_uid, file_name, size_bytes, content_hash, category).

    The first of: equal content in the same category, equal content, equal name and size, equal name (no duplicate, but told).
    Of several stored files the first by ``order``. A stored file is found by equality of content or name, never pair by pair.
    """
    s = stored.select(F.col("flow_uid").alias("duplicate_of"), F.col(order).alias("_order"), *[F.col(c).alias(f"_{c}") for c in ("file_name", "size_bytes", "content_hash", "category")])
    same_category = F.lower(F.coalesce("category", F.lit(""))) == F.lower(F.coalesce("_category", F.lit("")))
    first = lambda rows, rank: rows.select("file_uid", F.struct(rank.alias("rank"), "_order", "duplicate_of").alias("hit")).groupBy("file_uid").agg(F.min("hit").alias("hit"))
    by_content = first(new.join(s, F.col("content_hash") == F.col("_content_hash")), F.when(same_category, 1).otherwise(2))
    by_name = first(new.join(s, F.col("file_name") == F.col("_file_name")), F.when(F.col("size_bytes") == F.col("_size_bytes"), 3).otherwise(4))
    best = by_content.union(by_name).groupBy("file_uid").agg(F.min("hit").alias("hit"))
    named = F.get(F.array(*map(F.lit, ("content_hash", "content_hash_other_category", "name_and_size", "name_only"))), F.col("hit.rank") - 1)
    return new.select("file_uid").join(best, "file_uid", "left").select("file_uid", "hit.duplicate_of", named.alias("matched_on"), F.coalesce(F.col("hit.rank") < 4, F.lit(False)).alias("is_duplicate"))
