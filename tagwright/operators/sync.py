"""A graph's edits by hand back to the tables that its nodes come from, and uploads of nodes and edges by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.text import entity_uid

EDITED = "ui_update"
CONNECTED = "CONNECTED_TO"


def _blank(c: str | Column) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(""))


def table_edits(nodes: DataFrame, keys: dict[str, str], columns: dict[str, list[str]], allowed: dict[str, list[str]], renamed: dict[tuple[str, str], str]) -> DataFrame:
    """What edits by hand change: table, key_column, key, column, value; one row for each cell.

    ``nodes``: node_id ``key#table``, label, properties map, lineage map (property -> source). A property whose lineage is ``ui_update`` goes
    to each table that ``allowed`` names for the label, that has the column (``columns``) and the key column of the node's own table (``keys``);
    ``renamed`` maps (label, property) to another column. Where no property is marked but the node is (lineage of ``source``),
    all its properties go to its own table, but for the key. Nodes without a table, or of a table without a key, change nothing. Of nodes that
    change one cell the largest id counts.
    """
    spark = nodes.sparkSession
    own = F.substring_index("node_id", "#", 1).alias("key"), F.expr("CASE WHEN instr(node_id, '#') > 0 THEN substr(node_id, instr(node_id, '#') + 1) END").alias("own_table")
    held = F.transform_values("properties", lambda k, v: F.struct(v.alias("value"), F.coalesce(F.try_element_at("lineage", k), F.lit("")).alias("by")))
    rows = nodes.where(F.size("properties") > 0).select("node_id", "label", *own, held.alias("held"), F.coalesce(F.try_element_at("lineage", F.lit("source")), F.lit("")).alias("source"))
    marked = F.map_filter("held", lambda k, x: x["by"] == EDITED)
    whole = (F.size(marked) == 0) & (F.col("source") == EDITED)
    cells = rows.select("node_id", "label", "key", "own_table", whole.alias("whole"), F.explode(F.when(whole, F.col("held")).otherwise(marked)).alias("property", "x")).select("*", "x.value").drop("x")
    new = F.lit(None).cast("string")
    for (label, prop), column in renamed.items():
        new = F.when((F.col("label") == label) & (F.col("property") == prop), column).otherwise(new)
    cells = cells.withColumn("column", F.when(F.col("whole"), F.col("property")).otherwise(F.coalesce(new, "property")))
    # the model's tables are a configured list, a row for each column that a label's edits of a table's node can reach
    ways = [(label, o, t, keys[o], c, False) for label, tables in allowed.items() for t in tables for o in keys for c in columns.get(t, []) if t in keys and keys[o] in columns.get(t, [])]
    ways += [(None, o, o, keys[o], c, True) for o in keys for c in columns.get(o, []) if c != keys[o]]
    routes = F.broadcast(spark.createDataFrame(ways, "r_label string, r_own string, table string, key_column string, r_column string, r_whole boolean"))
    met = cells.join(routes, (F.col("own_table") == F.col("r_own")) & (F.col("column") == F.col("r_column")) & (F.col("whole") == F.col("r_whole")) & (F.col("r_whole") | (F.col("label") == F.col("r_label"))))
    met = met.where(F.col("key") != "").where(~F.col("whole") | F.col("value").isNotNull())
    return met.groupBy("table", "key_column", "key", "column").agg(F.max_by("value", "node_id").alias("value"))


def with_edits(df: DataFrame, edits: DataFrame, table: str) -> DataFrame:
    """``df``, the rows of ``table``, after its edits: one join for each key column that they use. Edits of rows that are not there add none."""
    names = [r.key_column for r in edits.where(F.col("table") == table).select("key_column").distinct().orderBy("key_column").collect()]  # a few names
    for key in names:
        own = edits.where((F.col("table") == table) & (F.col("key_column") == key))
        cells = own.groupBy(F.col("key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_new"))  # at most a cell for each column
        both = df.join(cells, F.col(key).cast("string") == F.col("_key"), "left")
        put = lambda c, kind: F.when(F.map_contains_key("_new", F.lit(c)), F.try_element_at("_new", F.lit(c)).try_cast(kind)).otherwise(F.col(c)).alias(c)
        df = both.withColumn("_new", F.coalesce("_new", F.create_map().cast("map<string,string>"))).select(*[put(c, kind) for c, kind in df.dtypes])
    return df


def missing_links(nodes: DataFrame, edges: DataFrame, stored: DataFrame, connected: bool) -> DataFrame:
    """from_ref, to_ref, rel_type of edges that the table of connections (or of other relations) has not yet.

    ``nodes``: node_id, name, properties map; a node's reference is its equipment_id, else its normalized_asset, else its name. ``edges``:
    relationship_id, from_node_id, to_node_id, rel_type; ``stored``: from_ref, to_ref. Pairs of references stand once, with the type of the
    first edge by id; edges whose node or reference is missing give none.
    """
    prop = lambda k: F.nullif(F.try_element_at("properties", F.lit(k)), F.lit(""))
    ref = nodes.select("node_id", F.coalesce(prop("equipment_id"), prop("normalized_asset"), F.nullif("name", F.lit(""))).alias("ref")).where("ref is not null")
    own = edges.where((F.col("rel_type") == CONNECTED) if connected else (F.col("rel_type") != CONNECTED))
    ends = own.join(ref.select(F.col("node_id").alias("from_node_id"), F.col("ref").alias("from_ref")), "from_node_id").join(ref.select(F.col("node_id").alias("to_node_id"), F.col("ref").alias("to_ref")), "to_node_id")
    new = ends.groupBy("from_ref", "to_ref").agg(F.min_by("rel_type", "relationship_id").alias("rel_type"))
    return new.join(stored.select("from_ref", "to_ref"), ["from_ref", "to_ref"], "left_anti")


def upload(batch: str, node_rows: DataFrame, edge_rows: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and rejects (sheet, row, reason) of an upload of rows that name nodes.

    ``node_rows``: row, label, name, properties map; ``edge_rows``: row, rel_type, from_name, to_name, properties map; ``stored``: node_id,
    name. Blanks around texts don't count. A node without label or name is rejected; a name that repeats is told, and edges of that
    name go to its last row. Edges find names in the upload first, then among stored nodes (the smallest id). Rows that are blank all through are
    passed over; an edge without a type or a name, or whose name nobody has, is rejected, for its first fault. Ids come from batch and row, so that an
    upload that is sent twice makes the same nodes.
    """
    n = node_rows.select("row", _blank("label").alias("label"), _blank("name").alias("name"), "properties")
    good = n.where("label is not null and name is not null").select(entity_uid("node", F.lit(batch), F.col("row").cast("string")).alias("node_id"), "*")
    names = good.groupBy("name").agg(F.max_by("node_id", "row").alias("node_id"), F.min("row").alias("first"))
    again = good.select("name", "row").join(names.select("name", "first"), "name").where("row > first")
    said = lambda df, sheet, reason: df.select(F.lit(sheet).alias("sheet"), "row", reason.alias("reason"))
    rejects = said(n.where("label is null or name is null"), "node", F.lit("label and name are required"))
    rejects = rejects.union(said(again, "node", F.concat(F.lit("duplicate name "), "name")))

    blank = lambda m: F.forall(F.map_values(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda v: F.trim(F.coalesce(v, F.lit(""))) == "")
    e = edge_rows.select("row", *[_blank(c).alias(c) for c in ("rel_type", "from_name", "to_name")], "properties")
    e = e.where(~(F.col("rel_type").isNull() & F.col("from_name").isNull() & F.col("to_name").isNull() & blank(F.col("properties"))))
    whole = F.col("rel_type").isNotNull() & F.col("from_name").isNotNull() & F.col("to_name").isNotNull()
    rejects = rejects.union(said(e.where(~whole), "relationship", F.lit("rel_type, from_name and to_name are required")))
    older = stored.groupBy("name").agg(F.min("node_id").alias("node_id")).join(names, "name", "left_anti")
    known = names.select("name", "node_id").union(older.select("name", "node_id"))
    end = lambda side: known.select(F.col("name").alias(f"{side}_name"), F.col("node_id").alias(f"{side}_node_id"))
    met = e.where(whole).join(end("from"), "from_name", "left").join(end("to"), "to_name", "left")
    unknown = F.when(F.col("from_node_id").isNull(), F.col("from_name")).when(F.col("to_node_id").isNull(), F.col("to_name"))
    rejects = rejects.union(said(met.where(unknown.isNotNull()), "relationship", F.concat(F.lit("no node is named "), unknown)))
    edges = met.where(unknown.isNull()).select(entity_uid("edge", F.lit(batch), F.col("row").cast("string")).alias("relationship_id"), "from_node_id", "to_node_id", "rel_type", "properties")
    return good.select("node_id", "label", "name", "properties"), edges, rejects


def resolved_paths(tags: DataFrame, paths: DataFrame, ids: DataFrame) -> DataFrame:
    """tag, path of short names of series (``tags``: tag) among ``paths`` (path, seq).

    A tag that begins with ``root.`` is a path. Else the first path by ``seq`` counts whose last segments are the tag's; without one, the same
    for the id that ``ids`` (tag, series_id) has for the tag, or, where it has none, for the tag with ``_`` for dots, blanks, dashes and
    slashes and without other marks. A tag that finds nothing has no path. Paths are looked up by their ends, so tags meet only paths that end alike.
    """
    segments = F.split("path", r"\.")
    ends = paths.select("path", "seq", segments.alias("s")).select("path", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda k: F.array_join(F.slice("s", -k, k), "."))).alias("end"))
    first = ends.groupBy("end").agg(F.min_by("path", "seq").alias("path"))
    one_id = ids.groupBy("tag").agg(F.min("series_id").alias("series_id"))
    plain = F.regexp_replace(F.regexp_replace("tag", r"[.\s\-/]", "_"), "[^a-zA-Z0-9_]", "")
    asked = tags.select("tag").distinct().join(one_id, "tag", "left")
    other = F.when(F.coalesce(_blank("series_id"), "tag") == F.col("tag"), plain).otherwise(F.col("series_id"))
    asked = asked.select("tag", other.alias("other"))
    found = asked.join(first.select(F.col("end").alias("tag"), F.col("path").alias("_own")), "tag", "left").join(first.select(F.col("end").alias("other"), F.col("path").alias("_other")), "other", "left")
    return found.select("tag", F.when(F.startswith("tag", F.lit("root.")), F.col("tag")).otherwise(F.coalesce("_own", "_other")).alias("path"))
