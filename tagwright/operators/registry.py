"""Graph nodes from records of many tables: one node for each key, what each property's sources are, by which names it is found; chains of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels whose nodes need no primary key, and the table that stands in a location's id whatever table named it.
KEYLESS = ("Plant", "FunctionalLocation", "Issue", "Parameter", "Cause", "Check")
LOCATION, LOCATION_TABLE = "FunctionalLocation", "functional_location"
EDITED = "ui_update"


def _clean(c: str | Column) -> Column:
    return F.trim(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))


def with_ids(records: DataFrame) -> DataFrame:
    """``records`` (label, key, table, pk, ...) with ``_key`` in upper case and node_id ``pk#table``, or ``key#table`` of labels without keys; others are none."""
    key = F.upper(_clean("key"))
    table = F.when(F.col("label") == LOCATION, LOCATION_TABLE).otherwise(F.coalesce("table", F.lit("unknown")))
    base = F.coalesce(F.nullif(_clean("pk"), F.lit("")), F.when(F.col("label").isin(*KEYLESS), key))
    rows = records.withColumns({"_key": key, "node_id": F.concat(base, F.lit("#"), table)})
    return rows.where((F.col("_key") != "") & (F.lower("_key") != "nan") & F.col("node_id").isNotNull())


def register(records: DataFrame, edited: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, label, properties map, lineage map of source lists) and aliases (label, alias, plant, node_id, seq).

    ``records``: label, key, table, pk, plant, source, seq, properties map. They register by ``seq``: the first of a node gives its
    label, ``name`` (its key; of Equipment its normalized_asset), ``equipment_id`` (the key, of Equipment), plant and asset code; then every
    record's own properties go over the earlier ones. A property's lineage lists the sources that gave it, the first first. ``edited``
    (node_id, property, value) stands over all. Blank values give nothing. The first record of a label and node also
    registers its key as an alias under its plant, and of Equipment the equipment_id and asset_code; a Plant has no plant.

    Sources are counted out a property before anything is gathered, so a node that every record names is no large group.
    """
    rows = with_ids(records)
    prop = lambda k: F.nullif(F.upper(_clean(F.try_element_at("properties", F.lit(k)))), F.lit(""))
    rows = rows.withColumns({"_plant": F.when(F.col("label") != "Plant", F.nullif(F.upper(_clean("plant")), F.lit(""))), "_code": F.when(F.col("label") != "Plant", prop("asset_code")), "_id": F.when(F.col("label") != "Plant", prop("equipment_id"))})
    equipment = F.col("label") == "Equipment"
    name = F.when(equipment, F.nullif(_clean(F.try_element_at("properties", F.lit("normalized_asset"))), F.lit("")))
    default = {"name": F.coalesce(name, "_key"), "equipment_id": F.when(equipment, F.col("_key")), "plant_code": F.col("_plant"), "asset_code": F.col("_code")}
    defaults = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in default.items()])
    first = rows.groupBy("node_id").agg(F.min_by(F.struct("label", "source", defaults.alias("entries")), "seq").alias("f"), F.min("seq").alias("seq"))
    given = first.select("node_id", "seq", F.lit(0).alias("own"), "f.source", F.explode("f.entries").alias("e")).union(rows.select("node_id", "seq", F.lit(1), "source", F.explode(F.map_entries("properties")).alias("e")))
    given = given.select("node_id", F.col("e.key").alias("property"), F.col("e.value").alias("value"), F.struct("seq", "own").alias("at"), "source").where(F.trim("value") != "")
    by_source = given.groupBy("node_id", "property", "source").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("last"), F.min("at").alias("first"))
    if edited is not None:
        held = edited.select("node_id", "property").distinct()
        own = edited.groupBy("node_id", "property").agg(F.max("value").alias("value"))
        by_source = by_source.join(held, ["node_id", "property"], "left_anti")
    sources = F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"])
    entries = by_source.groupBy("node_id", "property").agg(F.max_by("value", "last").alias("value"), sources.alias("sources"))
    if edited is not None:
        entries = entries.union(own.join(first.select("node_id"), "node_id", "left_semi").select("node_id", "property", "value", F.array(F.lit(EDITED))))
    pair = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("property").alias("key"), F.col(v).alias("value")))))
    nodes = entries.groupBy("node_id").agg(pair("value").alias("properties"), pair("sources").alias("lineage")).join(first.select("node_id", "f.label"), "node_id").select("node_id", "label", "properties", "lineage")

    named = rows.groupBy("label", "node_id").agg(F.min_by(F.struct("_key", "_plant", "_id", "_code"), "seq").alias("r"), F.min("seq").alias("seq"))
    real = lambda c: F.when((F.col("label") == "Equipment") & (F.col(c) != "NONE"), F.col(c))
    names = F.array_distinct(F.array_compact(F.array("r._key", real("r._id"), real("r._code"))))
    aliases = named.select("label", F.explode(names).alias("alias"), F.coalesce("r._plant", F.lit("")).alias("plant"), "node_id", "seq")
    return nodes, aliases


def issue_chains(rows: DataFrame, table: str = "symbolic_ai") -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, label, name, properties map) and edges (from_node_id, to_node_id, rel_type) of rows of issues.

    ``rows``: row_id, equipment, node_id (of the equipment, or null), issue, parameter, cause, check. A row is a chain below its
    equipment: an Issue, and where other rows of the equipment have the same issue, a Parameter; where they have the same
    parameter as well, a Cause; where also the same cause, a Check; each only if the row says what it is. What the row says beyond
    its chain's end becomes properties of the last node. Blanks around values don't count. Rows without equipment or issue give nothing; a
    row without an id has no Issue node and so no edge to or from it.
    """
    rows = rows.select("node_id", *[_clean(F.col(c).cast("string")).alias(c) for c in ("row_id", "equipment", "issue", "parameter", "cause", "check")])
    keys = ["equipment", "issue", "parameter", "cause"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_cause"))  # counted before windows see them: a busy issue is few rows
    counts = counts.withColumns({"n_issue": F.sum("n_cause").over(Window.partitionBy(*keys[:2])), "n_parameter": F.sum("n_cause").over(Window.partitionBy(*keys[:3]))})
    rows = rows.where(F.col("node_id").isNotNull() & (F.col("equipment") != "") & (F.col("issue") != "")).join(counts, keys)
    two = (F.col("n_issue") > 1) & (F.col("parameter") != "")
    three = two & (F.col("n_parameter") > 1) & (F.col("cause") != "")
    four = three & (F.col("n_cause") > 1) & (F.col("check") != "")
    rows = rows.withColumn("depth", F.when(four, 4).when(three, 3).when(two, 2).otherwise(1))

    said = ("issue", "parameter", "cause", "check")
    levels, key = [], F.col("row_id")
    for level, (label, rel_type, column) in enumerate(zip(("Issue", "Parameter", "Cause", "Check"), ("HAS_SYMBOLIC", "PARAMETER", "HAS_CAUSE", "HAS_CHECK"), said), 1):
        key = key if level == 1 else F.concat(key, F.lit("_"), F.col(column))
        own = [F.struct(F.lit("name").alias("key"), F.col(column).alias("value")), F.struct(F.lit(column).alias("key"), F.col(column).alias("value"))]
        rest = [F.when((F.col("depth") == level) & (F.col(c) != ""), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c in said[level:]]
        node = F.when(key != "", F.concat(F.upper(key), F.lit(f"#{table}")))
        levels.append(F.struct(F.lit(level).alias("level"), F.lit(label).alias("label"), F.lit(rel_type).alias("rel_type"), node.alias("id"), F.col(column).alias("name"), F.map_from_entries(F.array_compact(F.array(*own, *rest))).alias("properties")))
    chains = rows.select("node_id", F.filter(F.array(*levels), lambda x: x["level"] <= F.col("depth")).alias("chain"))
    nodes = chains.select(F.explode("chain").alias("x")).where("x.id is not null").select(F.col("x.id").alias("node_id"), "x.label", "x.name", "x.properties").dropDuplicates(["node_id"])
    above = lambda k: F.when(k == 0, F.col("node_id")).otherwise(F.get(F.col("chain"), k - 1)["id"])
    pairs = F.transform("chain", lambda x, k: F.struct(above(k).alias("a"), x["id"].alias("b"), x["rel_type"].alias("t")))
    edges = chains.select(F.explode(pairs).alias("e")).where("e.a is not null and e.b is not null").select(F.col("e.a").alias("from_node_id"), F.col("e.b").alias("to_node_id"), F.col("e.t").alias("rel_type")).distinct()
    return nodes, edges
