"""Nodes (node_id, ...) and edges (relationship_id, from_node_id, to_node_id, rel_type): neighbours, paths, trees.

Traversals join a frontier with the edges once a hop; the visited set is a DataFrame, and every few hops the frontier is
checkpointed so that plans stay short and a lost executor costs a read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwright.functions.text import entity_uid
from tagwright.sources.shared import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint in the shared folder."""
    context, folder = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    if not (context.getCheckpointDir() or "").startswith(folder):
        context.setCheckpointDir(folder)
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("from_node_id").alias("node_id"), F.col("to_node_id").alias("other"), "relationship_id", "rel_type")
    b = edges.select(F.col("to_node_id").alias("node_id"), F.col("from_node_id").alias("other"), "relationship_id", "rel_type")
    return a.union(b)


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes one hop from ``seeds`` (node_id) in either direction, seeds included."""
    near = both_ways(edges).join(seeds.select("node_id").distinct(), "node_id", "left_semi").select(F.col("other").alias("node_id"))
    return near.union(seeds.select("node_id")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("node_id").distinct()
    one = edges.join(ids.withColumnRenamed("node_id", "from_node_id"), "from_node_id", "left_semi")
    return one.join(ids.withColumnRenamed("node_id", "to_node_id"), "to_node_id", "left_semi")


def distances(edges: DataFrame, start: str, most: int = 7) -> DataFrame:
    """Hops and one shortest path (the smallest by text) from ``start`` to every node within ``most`` hops, either direction."""
    spark: SparkSession = edges.sparkSession
    way = cut(both_ways(edges).select("node_id", "other").distinct())  # read once, joined at every hop
    seen = spark.createDataFrame([(start, 0, start)], "node_id string, hops int, path string")
    front = seen
    for hop in range(1, most + 1):
        step = way.join(front, "node_id").select(F.col("other").alias("node_id"), F.lit(hop).alias("hops"), F.concat("path", F.lit(">"), "other").alias("path"))
        front = cut(step.groupBy("node_id", "hops").agg(F.min("path").alias("path")).join(seen.select("node_id"), "node_id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def tree(edges: DataFrame, root: str, types: list[str], most: int = 10, upward: bool = False) -> DataFrame:
    """Nodes below (or above) ``root`` over edges of ``types`` with their level; a node stands once for each way that leads to it.

    Ways are counted, not walked: a hop joins each node once, with the number of ways so far, and the rows of that number are made at the end.
    """
    a, b = ("to_node_id", "from_node_id") if upward else ("from_node_id", "to_node_id")
    way = cut(edges.where(F.col("rel_type").isin(*types)).groupBy(F.col(a).alias("_at"), F.col(b).alias("node_id")).agg(F.count("*").alias("_n")))  # read once
    front = way.where(F.col("_at") == root).select("node_id", "_n", F.lit(1).alias("level"))
    out = front
    for level in range(2, most + 1):
        step = front.select(F.col("node_id").alias("_at"), F.col("_n").alias("_ways")).join(way, "_at")
        front = cut(step.groupBy("node_id").agg(F.sum(F.col("_ways") * F.col("_n")).alias("_n")).select("node_id", "_n", F.lit(level).alias("level")))
        if front.isEmpty():
            break
        out = out.union(front)
    return out.select("node_id", "level", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_copy")).drop("_copy")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("to_node_id").alias("node_id")), "node_id", "left_anti")


def relationships(rows: DataFrame, plant: str, rel_type: str, parent: str, child: str, parents: DataFrame, children: DataFrame) -> DataFrame:
    """Edges from ``rows`` whose two ends are among the entities (plant, key, uid); others give none."""
    p = parents.select(F.col("plant").alias(plant), F.col("key").alias(parent), F.col("uid").alias("parent_uid"))
    c = children.select(F.col("plant").alias(plant), F.col("key").alias(child), F.col("uid").alias("child_uid"))
    joined = rows.select(plant, parent, child).distinct().join(p, [plant, parent]).join(c, [plant, child])
    return joined.select(entity_uid("rel", plant, F.lit(rel_type), "parent_uid", "child_uid").alias("relationship_uid"), F.lit(rel_type).alias("rel_type"), "parent_uid", "child_uid")


def one_edge_each(edges: DataFrame, symmetric: list[str]) -> DataFrame:
    """One edge for each ordered pair of nodes: from_node_id, to_node_id, rel_type, priority.

    Edges come in the order of ``seq``; loops and edges without an end are none. A pair keeps the type of its first edge until
    one of another type has a higher priority. An edge of a ``symmetric`` type is left out where the opposite edge has that
    type at the time. An edge that repeats the one before it changes nothing and goes before a pair's edges are gathered.
    """
    rel_type = F.replace(F.upper(F.trim("rel_type")), F.lit(" "), F.lit("_"))
    ends = edges.where("from_node_id <> to_node_id").withColumn("rel_type", rel_type)
    ends = ends.select(F.least("from_node_id", "to_node_id").alias("low"), F.greatest("from_node_id", "to_node_id").alias("high"), (F.col("from_node_id") < F.col("to_node_id")).alias("up"), "rel_type", "priority", "seq")
    what = F.struct("up", "rel_type", "priority")
    ends = ends.withColumn("_prior", F.lag(what).over(Window.partitionBy("low", "high").orderBy("seq"))).where(~what.eqNullSafe(F.col("_prior")))
    events = F.array_sort(F.collect_list(F.struct("seq", "up", "rel_type", "priority")))
    none = F.lit(None).cast(f"struct<rel_type:string,priority:{dict(ends.dtypes)['priority']}>")

    def step(state, e):
        own, other = F.when(e["up"], state["up"]).otherwise(state["down"]), F.when(e["up"], state["down"]).otherwise(state["up"])
        dropped = e["rel_type"].isin(*symmetric) & F.coalesce(other["rel_type"] == e["rel_type"], F.lit(False)) if symmetric else F.lit(False)
        kept = F.struct(F.when(own.isNull() | (e["priority"] > own["priority"]), e["rel_type"]).otherwise(own["rel_type"]).alias("rel_type"), F.greatest(own["priority"], e["priority"]).alias("priority"))
        now = F.when(dropped, own).otherwise(kept)
        return F.struct(F.when(e["up"], now).otherwise(state["up"]).alias("up"), F.when(e["up"], state["down"]).otherwise(now).alias("down"))

    pairs = ends.groupBy("low", "high").agg(F.aggregate(events, F.struct(none.alias("up"), none.alias("down")), step).alias("s"))
    both = F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b"), F.col("s.up").alias("e")), F.struct(F.col("high").alias("a"), F.col("low").alias("b"), F.col("s.down").alias("e")))
    return pairs.select(F.explode(both).alias("p")).where("p.e is not null").select(F.col("p.a").alias("from_node_id"), F.col("p.b").alias("to_node_id"), "p.e.rel_type", "p.e.priority")


def property_keys(nodes: DataFrame, properties: str) -> DataFrame:
    """Labels with the distinct keys of their JSON properties."""
    return nodes.select("label", F.explode(F.json_object_keys(properties)).alias("key")).distinct()


def fan_depth(edges: DataFrame) -> DataFrame:
    """Edges with how many edges leave their first node and how many enter their second. Degrees are counted before they are joined: a hub is one row."""
    out = edges.groupBy("from_node_id").agg(F.count("*").alias("out_degree"))
    into = edges.groupBy("to_node_id").agg(F.count("*").alias("in_degree"))
    return edges.join(out, "from_node_id").join(into, "to_node_id")


def search(nodes: DataFrame, wanted: str, most: int, properties: str = "properties") -> DataFrame:
    """Nodes (node_id, name, label, JSON properties) that a name finds: exact hits first, then by name. Case is ignored but in ids."""
    low, p = wanted.lower(), lambda k: F.lower(F.get_json_object(properties, f"$.{k}"))
    exact = (F.col("node_id") == wanted) | (F.lower("name") == low) | (p("tag_name") == low) | (p("equipment_id") == low)
    part = F.contains(F.lower("name"), F.lit(low)) | F.contains(p("tag_name"), F.lit(low)) | (F.contains(p("equipment_id"), F.lit(low)) & F.col("label").isin("Equipment", "Plant"))
    hits = nodes.where(F.coalesce(F.col("node_id") == wanted, F.lit(False)) | F.coalesce(part, F.lit(False)))
    return hits.select("node_id", "name", "label", F.when(F.coalesce(exact, F.lit(False)), 1).otherwise(0).alias("is_exact")).distinct().orderBy(F.desc("is_exact"), "name", "node_id").limit(most)


def linked(edges: DataFrame, nodes: DataFrame, root: str, label: str) -> DataFrame:
    """Nodes of a label at the other end of the root's edges, with the edge's type; either direction."""
    out = edges.where(F.col("from_node_id") == root).select(F.col("to_node_id").alias("node_id"), "rel_type")
    back = edges.where(F.col("to_node_id") == root).select(F.col("from_node_id").alias("node_id"), "rel_type")
    return out.union(back).distinct().join(nodes.where(F.col("label") == label), "node_id")


def tags_of(edges: DataFrame, nodes: DataFrame, rel_type: str = "HAS_TAG") -> DataFrame:
    """equipment, tag: names at both ends of edges of a type, whichever way the edge goes."""
    name = lambda side: nodes.select(F.col("node_id").alias(side), F.col("name").alias(f"{side}_name"), F.col("label").alias(f"{side}_label"))
    e = edges.where(F.col("rel_type") == rel_type).join(name("from_node_id"), "from_node_id").join(name("to_node_id"), "to_node_id")
    forward = e.where("from_node_id_label = 'Equipment'").select(F.col("from_node_id_name").alias("equipment"), F.col("to_node_id_name").alias("tag"))
    return forward.union(e.where("to_node_id_label = 'Equipment' and from_node_id_label <> 'Equipment'").select(F.col("to_node_id_name").alias("equipment"), F.col("from_node_id_name").alias("tag"))).distinct()


def expand(edges: DataFrame, front: DataFrame, hops: int) -> DataFrame:
    """node_id, hop: what is within so many hops of the ``front`` (node_id), each at its first hop. Each hop meets only the nodes of the last."""
    ways = cut(edges.select(F.col("from_node_id").alias("a"), F.col("to_node_id").alias("node_id")).union(edges.select("to_node_id", "from_node_id")).distinct())  # read once
    seen = front.select("node_id", F.lit(0).alias("hop")).distinct()
    last = seen
    for hop in range(1, hops + 1):
        last = cut(last.select(F.col("node_id").alias("a")).join(ways, "a").select("node_id").distinct().join(seen.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(last)
    return seen


def apply_changes(stored: DataFrame, changes: DataFrame, key: str = "node_id", properties: str = "properties") -> DataFrame:
    """Stored rows (key, properties map) after a batch of changes (key, op, seq, properties map, property).

    ``delete`` takes the row, ``upsert`` puts its entries over the row's, ``delete_property`` takes one entry; the changes of a
    row come in order. A change to a row that is not there is one to an empty row, which only an upsert makes.
    """
    empty = F.create_map().cast("map<string,string>")
    gone = F.lit(None).cast("map<string,string>")
    steps = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "op", F.col("property").alias("property"), F.coalesce(F.map_entries(F.col(properties)), F.array().cast("array<struct<key:string,value:string>>")).alias("new")))).alias("_steps"))

    def step(now, s):
        new = F.map_from_entries(s["new"])
        held = F.coalesce(now, empty)
        over = F.map_concat(F.map_filter(held, lambda k, v: ~F.map_contains_key(new, k)), new)
        less = F.when(now.isNotNull(), F.map_filter(held, lambda k, v: k != s["property"]))
        return F.when(s["op"] == "upsert", over).when(s["op"] == "delete_property", less).otherwise(gone)

    both = stored.join(steps, key, "full")
    after = F.when(F.col("_steps").isNull(), F.col(properties)).otherwise(F.aggregate("_steps", F.col(properties), step))
    return both.select(key, after.alias(properties)).where(F.col(properties).isNotNull())


def find_equipment(asked: DataFrame, equipment: DataFrame) -> DataFrame:
    """``asked`` (key, plant) with node_id: the first node (by seq) of that key and plant, else of no plant, else of any; blanks and case ignored."""
    clean = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    nodes = equipment.groupBy(clean("key").alias("_k"), clean("plant").alias("_p")).agg(F.min(F.struct("seq", "node_id")).alias("_n"))
    anywhere = nodes.groupBy("_k").agg(F.min("_n").alias("_any"))
    rows = asked.withColumns({"_ak": clean("key"), "_ap": clean("plant")})
    own = nodes.select(F.col("_k").alias("_ok"), F.col("_p").alias("_op"), F.col("_n").alias("_own"))
    none = nodes.where("_p = ''").select(F.col("_k").alias("_nk"), F.col("_n").alias("_none"))
    out = rows.join(own, (F.col("_ak") == F.col("_ok")) & (F.col("_ap") == F.col("_op")), "left").join(none, F.col("_ak") == F.col("_nk"), "left").join(anywhere, F.col("_ak") == F.col("_k"), "left")
    return out.select(*asked.columns, F.coalesce("_own.node_id", "_none.node_id", "_any.node_id").alias("node_id"))


def build(tables: dict[str, DataFrame], nodes: dict[str, tuple[str, str, str]], links: list[tuple[str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id ``key#table``, label, name) of model tables, ``nodes`` (table -> key, label, name), and edges between them.

    ``links`` are (table, reference column, table referred to, type); a reference that no row has gives no edge.
    """
    node_id = lambda c, t: F.concat(F.col(c).cast("string"), F.lit(f"#{t}"))
    rows = [tables[t].where(F.col(k).isNotNull()).select(node_id(k, t).alias("node_id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name")) for t, (k, label, name) in nodes.items()]
    edges = []
    for t, ref, parent, rel_type in links:
        ids = tables[parent].select(F.col(nodes[parent][0]).alias("_id")).distinct()
        child = tables[t].where(F.col(nodes[t][0]).isNotNull()).select(node_id(nodes[t][0], t).alias("from_node_id"), F.col(ref).alias("_id"))
        edges.append(child.join(ids, "_id").select("from_node_id", node_id("_id", parent).alias("to_node_id"), F.lit(rel_type).alias("rel_type")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return union(rows).distinct(), union(edges).distinct()
