"""Layered configuration: JSON documents merged at any depth, and what plants override of a site's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.operators.graph import cut


def leaves(layers: DataFrame) -> DataFrame:
    """key, layer, path (array of names), value (JSON text) and ``empty`` (an object without entries) of JSON objects ``layers`` (key, layer, doc).

    Lists are leaves. Objects are opened a level at a time, as deep as the deepest document goes.
    """
    front = layers.select("key", "layer", F.array().cast("array<string>").alias("path"), F.parse_json("doc").alias("v"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    found = None
    while True:
        empty = F.to_json("v") == "{}"
        done = front.where(~is_object | empty).select("key", "layer", "path", F.coalesce(F.to_json("v"), F.lit("null")).alias("value"), F.coalesce(empty, F.lit(False)).alias("empty"))
        found = done if found is None else found.union(done)
        names = front.where(is_object & ~empty).withColumn("name", F.explode(F.json_object_keys(F.to_json("v"))))
        quoted = F.concat(F.lit("$['"), "name", F.lit("']"))
        front = cut(names.select("key", "layer", F.array_append("path", F.col("name")).alias("path"), F.try_variant_get(F.col("v"), quoted, "variant").alias("v")))
        if front.isEmpty():
            return found


def deep_merged(layers: DataFrame) -> DataFrame:
    """key, doc: of each key the documents ``layers`` (key, layer, doc: a JSON object) merged, later layers over earlier ones.

    Objects merge entry by entry at any depth. Anything else (a text, a number, null, a list) takes the place of what earlier
    layers have there, and an object takes the place of an earlier layer's non-object. Names are in order. Documents that are null are
    passed over; a key without documents gives none. Names with a single quote are not supported.

    A leaf stays if no later layer has a leaf at its path or above it, nor anything below it. The paths that stay are put together from
    the deepest level up, by joins on paths, so a key may have any number of entries.
    """
    entries = cut(leaves(layers.where("doc is not null")).withColumn("id", F.monotonically_increasing_id()))
    above = F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", 1, k))
    spots = entries.select("id", "key", "layer", "empty", F.col("path").alias("own"), F.explode(above).alias("spot"))
    leaf_at = entries.where(~F.col("empty")).groupBy("key", F.col("path").alias("spot")).agg(F.max("layer").alias("leaf"))
    object_at = spots.where((F.col("spot") != F.col("own")) | F.col("empty")).groupBy("key", "spot").agg(F.max("layer").alias("object"))
    covered = spots.join(leaf_at, ["key", "spot"]).where(F.col("leaf") > F.col("layer")).select("id")
    opened = entries.where(~F.col("empty")).join(object_at.withColumnRenamed("spot", "path"), ["key", "path"]).where(F.col("object") > F.col("layer")).select("id")
    left = cut(entries.join(covered.union(opened).distinct(), "id", "left_anti").select("key", "path", "value", "empty").distinct())
    # an object that has entries after all is no empty one
    filled = left.select("key", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", 1, k))).alias("spot")).where(F.col("spot") != F.col("path")).select("key", F.col("spot").alias("path"), F.lit(True).alias("empty")).distinct()
    rows = cut(left.join(filled, ["key", "path", "empty"], "left_anti").select("key", "path", "value"))
    depth = rows.agg(F.max(F.size("path"))).first()[0] or 0
    name = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]\z", 1)
    for level in range(depth, 0, -1):
        deep = rows.where(F.size("path") == level)
        pairs = F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("name"), "value")))
        text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda x: F.concat(name(x["name"]), F.lit(":"), x["value"])), ","), F.lit("}"))
        joined = deep.groupBy("key", F.slice("path", 1, level - 1).alias("path")).agg(text.alias("value"))
        rows = rows.where(F.size("path") < level).unionByName(joined)
    return rows.select("key", F.col("value").alias("doc"))


def mappings(config: DataFrame, source: str) -> DataFrame:
    """plant, old, new: the renames of columns that plants have for a source in ``config`` (doc); none where there are none."""
    overrides = F.from_json(F.get_json_object("doc", "$.sap_processing.column_rename_overrides"), "map<string,string>")
    plants = config.select(F.explode(overrides).alias("plant", "own"))
    own = F.from_json(F.get_json_object("own", f"$.{source}.mappings"), "map<string,string>")
    return plants.select("plant", F.explode(own).alias("old", "new"))


def renamed_by_plant(df: DataFrame, plant: str, own: dict[str, dict[str, str]], default: dict[str, str]) -> DataFrame:
    """``df``, rows of several plants, with the columns that each plant's names stand for: its own renames over the site's ``default``.

    A target takes, for the rows of a plant, the column that the plant maps to it, else the one that the default maps to it unless the plant
    maps that column elsewhere, else a column of the target's own name. Columns that are mapped by nobody stay as they are; those that are mapped go.
    """
    plans = {p: {o: n for o, n in {**default, **m}.items() if o in df.columns} for p, m in own.items()}
    rest = {o: n for o, n in default.items() if o in df.columns}
    targets = list(dict.fromkeys(n for m in (rest, *plans.values()) for n in m.values()))
    mapped = {o for m in (rest, *plans.values()) for o in m}

    def value(target: str) -> Column:
        pick = lambda m: F.coalesce(*[F.col(o) for o, n in m.items() if n == target], *([F.col(target)] if target in df.columns and target not in m else []), F.lit(None))
        out = pick(rest)
        for p, m in plans.items():
            out = F.when(F.col(plant) == p, pick(m)).otherwise(out)
        return out.alias(target)

    return df.select(*[c for c in df.columns if c not in mapped and c not in targets], *[value(t) for t in targets])


def with_plant(df: DataFrame, plant: str, site: str = "-") -> DataFrame:
    """``df`` with plant_code_id overwritten and ``site`` where it is blank or missing set to a default."""
    own = F.nullif(F.trim(F.coalesce(F.col("site").cast("string"), F.lit(""))), F.lit("")) if "site" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"plant_code_id": F.lit(plant), "site": F.coalesce(own, F.lit(site))})
