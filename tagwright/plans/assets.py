"""Queries on assets: keys, lookups, ladders, relationships, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.functions import text as x
from tagwright.operators import graph, joins
from tagwright.operators import tables as t
from tagwright.plans.series import table

EDGES = """e AS (SELECT 'n' || n_nationkey AS from_node_id, 'r' || n_regionkey AS to_node_id, 'PART_OF' AS rel_type, 'n' || n_nationkey AS relationship_id FROM nation UNION ALL
SELECT 's' || s_suppkey, 'n' || s_nationkey, 'PART_OF', 's' || s_suppkey FROM supplier)"""
WAYS = "w AS (SELECT from_node_id AS a, to_node_id AS b FROM e UNION SELECT to_node_id, from_node_id FROM e)"
PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}


def edges(spark, d):
    """Suppliers are part of nations, nations of regions."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation = table(spark, d, "nation").select(node("n", "n_nationkey").alias("from_node_id"), node("r", "n_regionkey").alias("to_node_id"))
    supplier = table(spark, d, "supplier").select(node("s", "s_suppkey").alias("from_node_id"), node("n", "s_nationkey").alias("to_node_id"))
    return nation.union(supplier).withColumns({"rel_type": F.lit("PART_OF"), "relationship_id": F.col("from_node_id")})


def uid_mint(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", x.equipment_uid(F.lit(" plant a "), "s_name").alias("equipment_uid"), x.entity_uid("sup", F.col("s_suppkey"), "s_name").alias("entity_uid"))


def norm_text_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", x.normalize_asset("p_name").alias("asset"), x.normalize_tag("p_type").alias("tag"), x.match_key("p_brand").alias("key"), x.measurement_name("p_name").alias("measurement"))


def first_non_blank(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "  ").otherwise(F.col("o_orderstatus")))
    return o.select("o_orderkey", x.first_non_blank("status", "o_orderpriority").alias("value"))


def fanout_collapse(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity", "l_linenumber")
    return joins.collapsed_lookup(orders, lines, ["k"], ["l_quantity"], "l_linenumber").withColumn("l_quantity", F.round("l_quantity", 2))


def workorder_star(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n_lines"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return o.join(c, "o_custkey", "left").join(n, "c_nationkey", "left").join(r, "n_regionkey", "left").select("o_orderkey", "o_orderstatus", "quantity", "n_lines", "c_name", "n_name", "r_name")


def m1_validate(spark, d):
    return joins.repeated_keys(table(spark, d, "lineitem"), ["l_partkey"])


def modal_per_key(spark, d):
    return joins.modal(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


def known_flag(spark, d):
    rich = table(spark, d, "orders").where("o_totalprice > 100000")
    return joins.known(table(spark, d, "customer").select("c_custkey"), rich, "c_custkey", "o_custkey", "asset_mapped")


def orphans(spark, d):
    return joins.orphans(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey")


def first_known_word(spark, d):
    """The first word with letters and digits of each document that is a known one (a word of a benchmark item)."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z]{7,}"), 0)
    known = table(spark, d, "benchmark").select(F.explode(words("text")).alias("asset"))
    return joins.first_candidate(table(spark, d, "documents"), "doc_id", words("text"), known, "asset").withColumn("place", F.col("place").cast("long"))


def relationships(spark, d):
    plant = F.lit("p1").alias("plant")
    c = table(spark, d, "customer").select(plant, F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"))
    parents = table(spark, d, "nation").where("n_nationkey < 20").select(plant, F.col("n_nationkey").alias("key"), x.entity_uid("nat", "n_name").alias("uid"))
    children = c.select("plant", F.col("customer").alias("key"), x.entity_uid("cus", "customer").alias("uid"))
    return graph.relationships(c, "plant", "HAS_CUSTOMER", "nation", "customer", parents, children)


def relation_conflicts(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("from_node_id"), F.concat(F.lit("p"), F.col("l_suppkey") % 50).alias("to_node_id"), F.col("l_returnflag").alias("rel_type"), F.col("l_quantity").cast("int").alias("priority"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return graph.one_edge_each(li, ["N"])


def graph_neighbors(spark, d):
    seeds = spark.createDataFrame([("n3",), ("r1",)], "node_id string")
    e = edges(spark, d)
    near = graph.neighbours(e, seeds)
    return graph.induced(e, near).select("relationship_id", "from_node_id", "to_node_id")


def graph_path(spark, d):
    return graph.distances(edges(spark, d), "s1").withColumn("hops", F.col("hops").cast("long"))


def graph_breakdown(spark, d):
    return graph.tree(edges(spark, d), "r1", ["PART_OF"], upward=True).withColumn("level", F.col("level").cast("long"))


def graph_lineage(spark, d):
    return graph.tree(edges(spark, d), "s1", ["PART_OF"]).withColumn("level", F.col("level").cast("long"))


def graph_roots(spark, d):
    e = edges(spark, d)
    return graph.roots(e.select(F.col("from_node_id").alias("node_id")).union(e.select("to_node_id")).distinct(), e)


def bfs_fair_sample(spark, d):
    e = edges(spark, d).select(F.col("to_node_id").alias("parent"), F.col("from_node_id").alias("child"))
    return joins.per_parent(e, 40).withColumn("rank", F.col("rank").cast("long"))


def graph_fan_depth(spark, d):
    return graph.fan_depth(edges(spark, d)).select("relationship_id", "out_degree", "in_degree")


def vocab_fold(spark, d):
    return table(spark, d, "orders").select("o_orderkey", x.fold_vocabulary("o_orderpriority", {k.lower().replace("-", "_"): v for k, v in PRIORITIES.items()}).alias("priority"))


def instrument_parent(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("tag"), F.col("s_nationkey").alias("area"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("tag"), (F.col("n_nationkey") % 20).alias("area"))
    return joins.instrument_parent(s, n)


_TREE = "WITH RECURSIVE {e}, f AS (SELECT {b} AS node_id, 1::BIGINT AS level FROM e WHERE {a} = '{root}' UNION ALL SELECT e.{b}, level + 1 FROM f JOIN e ON e.{a} = f.node_id WHERE level < 10) SELECT * FROM f"

QUERIES = {
    "uid_mint": (uid_mint, "SELECT s_suppkey, 'eq:' || sha1('PLANT A|' || upper(trim(s_name))) AS equipment_uid, 'sup:' || sha1(s_suppkey || '|' || trim(s_name)) AS entity_uid FROM supplier"),
    "norm_text_keys": (
        norm_text_keys,
        r"SELECT p_partkey, trim(regexp_replace(upper(trim(p_name)), '\s+', ' ', 'g')) AS asset, regexp_replace(CASE WHEN regexp_matches(upper(p_type), '^[^ ]+ .*[0-9]') THEN regexp_extract(upper(p_type), '^[^ ]+ (.*)$', 1) ELSE upper(p_type) END, '[^A-Z0-9]', '', 'g') AS tag, regexp_replace(upper(p_brand), '[^A-Z0-9]+', '', 'g') AS key, regexp_replace(regexp_replace(p_name, '[.\s/-]', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS measurement FROM part",
    ),
    "first_non_blank": (first_non_blank, "SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderstatus = 'O' THEN '  ' ELSE o_orderstatus END), ''), nullif(trim(o_orderpriority), '')) AS value FROM orders"),
    "fanout_collapse": (fanout_collapse, "SELECT o_orderkey AS k, any_value(o_orderstatus) AS o_orderstatus, any_value(o_orderpriority) AS o_orderpriority, round(sum(l_quantity), 2) AS l_quantity, min(l_linenumber) AS l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "workorder_star": (workorder_star, "SELECT o_orderkey, o_orderstatus, quantity, n_lines, c_name, n_name, r_name FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS quantity, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"),
    "m1_validate": (m1_validate, "SELECT l_partkey::VARCHAR AS l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING n > 1"),
    "modal_per_key": (modal_per_key, "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1"),
    "known_flag": (known_flag, "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AS asset_mapped FROM customer"),
    "orphans": (orphans, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "first_known_word": (
        first_known_word,
        "WITH g AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS asset FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS asset, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{7,}'), 1) - 1 AS place FROM documents) SELECT doc_id, arg_min(asset, place) AS asset, min(place)::BIGINT AS place FROM w JOIN g USING (asset) GROUP BY 1",
    ),
    "relationships": (
        relationships,
        "WITH r AS (SELECT 'nat:' || sha1(n_name) AS parent_uid, 'cus:' || sha1(c_custkey::VARCHAR) AS child_uid FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey < 20) SELECT 'rel:' || sha1('p1|HAS_CUSTOMER|' || parent_uid || '|' || child_uid) AS relationship_uid, 'HAS_CUSTOMER' AS rel_type, parent_uid, child_uid FROM r",
    ),
    "relation_conflicts": (
        relation_conflicts,
        """WITH RECURSIVE l AS (SELECT least(l_partkey % 50, l_suppkey % 50) AS lo, greatest(l_partkey % 50, l_suppkey % 50) AS hi, l_partkey % 50 < l_suppkey % 50 AS num_up, 'p' || l_partkey % 50 AS a, 'p' || l_suppkey % 50 AS b, l_returnflag AS t, l_quantity::INTEGER AS p, l_orderkey * 100 + l_linenumber AS seq FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50),
e AS (SELECT lo, hi, a < b AS up, least(a, b) AS x, greatest(a, b) AS y, t, p, row_number() OVER (PARTITION BY lo, hi ORDER BY seq) AS rn FROM l),
r AS (SELECT DISTINCT lo, hi, x, y, 0::BIGINT AS rn, NULL::VARCHAR AS ut, NULL::INTEGER AS pu, NULL::VARCHAR AS dt, NULL::INTEGER AS pd FROM e UNION ALL
 SELECT r.lo, r.hi, r.x, r.y, e.rn, CASE WHEN NOT up OR (t = 'N' AND coalesce(dt = t, FALSE)) THEN ut WHEN ut IS NULL OR p > pu THEN t ELSE ut END, CASE WHEN NOT up OR (t = 'N' AND coalesce(dt = t, FALSE)) THEN pu ELSE greatest(pu, p) END,
  CASE WHEN up OR (t = 'N' AND coalesce(ut = t, FALSE)) THEN dt WHEN dt IS NULL OR p > pd THEN t ELSE dt END, CASE WHEN up OR (t = 'N' AND coalesce(ut = t, FALSE)) THEN pd ELSE greatest(pd, p) END FROM r JOIN e ON e.lo = r.lo AND e.hi = r.hi AND e.rn = r.rn + 1),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY rn DESC) = 1)
SELECT x AS from_node_id, y AS to_node_id, ut AS rel_type, pu AS priority FROM f WHERE ut IS NOT NULL UNION ALL SELECT y, x, dt, pd FROM f WHERE dt IS NOT NULL""",
    ),
    "graph_neighbors": (graph_neighbors, f"WITH {EDGES}, {WAYS}, n AS (SELECT b AS node_id FROM w WHERE a IN ('n3', 'r1') UNION SELECT unnest(['n3', 'r1'])) SELECT relationship_id, from_node_id, to_node_id FROM e WHERE from_node_id IN (FROM n) AND to_node_id IN (FROM n)"),
    "graph_path": (
        graph_path,
        f"WITH RECURSIVE {EDGES}, {WAYS}, p AS (SELECT 's1' AS node_id, 0::BIGINT AS hops, 's1' AS path, ['s1'] AS seen UNION ALL SELECT b, hops + 1, path || '>' || b, list_append(seen, b) FROM p JOIN w ON a = node_id WHERE hops < 7 AND NOT list_contains(seen, b)) SELECT node_id, min(hops) AS hops, arg_min(path, (hops, path)) AS path FROM p GROUP BY 1",
    ),
    "graph_breakdown": (graph_breakdown, _TREE.format(e=EDGES, a="to_node_id", b="from_node_id", root="r1")),
    "graph_lineage": (graph_lineage, _TREE.format(e=EDGES, a="from_node_id", b="to_node_id", root="s1")),
    "graph_roots": (graph_roots, f"WITH {EDGES} SELECT DISTINCT from_node_id AS node_id FROM e WHERE from_node_id NOT IN (SELECT to_node_id FROM e)"),
    "bfs_fair_sample": (bfs_fair_sample, f"WITH {EDGES} SELECT to_node_id AS parent, from_node_id AS child, row_number() OVER (PARTITION BY to_node_id ORDER BY from_node_id) AS rank FROM e ORDER BY rank, parent LIMIT 40"),
    "graph_fan_depth": (graph_fan_depth, f"WITH {EDGES} SELECT relationship_id, count(*) OVER (PARTITION BY from_node_id) AS out_degree, count(*) OVER (PARTITION BY to_node_id) AS in_degree FROM e"),
    "vocab_fold": (vocab_fold, "SELECT o_orderkey, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITIES.items()) + " ELSE o_orderpriority END AS priority FROM orders"),
    "instrument_parent": (instrument_parent, "WITH n AS (SELECT n_nationkey % 20 AS area, arg_min(n_name, (length(n_name), n_name)) AS parent FROM nation GROUP BY 1) SELECT s_name AS tag, s_nationkey AS area, parent FROM supplier LEFT JOIN n ON area = s_nationkey"),
}
