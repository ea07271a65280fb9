"""Queries on parts of graphs: what a budget buys, breadth-first starts, numbering, registering nodes, chains of issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.operators import budget, numbering, registry
from tagwright.plans.series import table


def places(spark, d):
    """Plants (nations, in a ring) and their equipment (suppliers)."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    nodes = n.selectExpr("concat('n', n_nationkey) AS node_id", "'Plant' AS label", "bigint(n_nationkey * 4) AS seq", "map('name', n_name, 'area', string(n_regionkey)) AS properties")
    nodes = nodes.union(s.selectExpr("concat('s', s_suppkey)", "'Equipment'", "s_suppkey", "map('name', s_name)"))
    edges = s.selectExpr("concat('e', s_suppkey) AS relationship_id", "concat('s', s_suppkey) AS from_node_id", "concat('n', s_nationkey) AS to_node_id", "s_suppkey * 31 % 101 AS seq", "map('k', 'v') AS properties")
    return nodes, edges.union(n.selectExpr("concat('x', n_nationkey)", "concat('n', n_nationkey)", "concat('n', (n_nationkey + 1) % 25)", "bigint(n_nationkey)", "map('k', 'v')"))


PLACES = """nodes AS (SELECT 'n' || n_nationkey AS node_id, n_nationkey * 4 AS seq, 2 AS np FROM nation UNION ALL SELECT 's' || s_suppkey, s_suppkey, 1 FROM supplier),
edges AS (SELECT 'e' || s_suppkey AS relationship_id, 's' || s_suppkey AS a, 'n' || s_nationkey AS b, s_suppkey * 31 % 101 AS seq, 1 AS np FROM supplier UNION ALL SELECT 'x' || n_nationkey, 'n' || n_nationkey, 'n' || (n_nationkey + 1) % 25, n_nationkey, 1 FROM nation)"""


def _told(nodes, edges):
    kept = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias("n_kept")
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "place", kept("properties")).union(edges.select(F.lit("edge"), "relationship_id", "place", kept("properties")))


def graph_sample(spark, d):
    return _told(*budget.sample(*places(spark, d), 200))


def graph_sample_rich(spark, d):
    """A budget that small graphs leave over for properties."""
    return _told(*budget.sample(*places(spark, d), 1000))


def graph_sample_poor(spark, d):
    return _told(*budget.sample(*places(spark, d), 7))


SEEDS = ["n3", "n4", "s7"]


def graph_expand_budget(spark, d):
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "node_id string")
    nodes, edges = places(spark, d)
    return _told(*budget.expand(nodes, edges, seeds, edges.where("seq % 7 = 1"), 40))


def _bought_sql(limit: int, nodes: str = "SELECT * FROM nodes", edges: str = "SELECT * FROM edges", seeds: str = "SELECT NULL AS node_id WHERE false", properties: bool = True) -> str:
    def pick(of: str, when: str) -> str:
        return f"""(SELECT i, CASE WHEN pick IS NULL THEN remaining ELSE remaining - 4 END AS remaining, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END AS taken
  FROM (SELECT *, CASE WHEN {when} AND remaining >= 4 THEN (SELECT min(ord) FROM e WHERE ready <= t.i AND NOT list_contains(t.taken, ord)) END AS pick FROM {of} t))"""

    step = "(SELECT i + 1 AS i, remaining - 2 AS remaining, taken FROM w WHERE remaining >= 2 AND i < (SELECT count(*) FROM n))"
    step = pick(pick(pick(step, "i % 2 = 0"), "i % 10 = 0"), "i % 10 = 0")
    kept = "greatest(0, least(np, money - before))::BIGINT" if properties else "0::BIGINT"
    return f"""WITH RECURSIVE {PLACES},
n AS (SELECT *, row_number() OVER (ORDER BY seq, node_id) AS rank FROM ({nodes})),
r AS (SELECT node_id, rank FROM n UNION ALL SELECT node_id, 0 FROM ({seeds})),
e AS (SELECT x.*, greatest(p.rank, q.rank) AS ready, row_number() OVER (ORDER BY x.seq, relationship_id) AS ord FROM ({edges}) x JOIN r p ON p.node_id = a JOIN r q ON q.node_id = b),
w AS (SELECT 0::BIGINT AS i, {limit}::BIGINT AS remaining, []::BIGINT[] AS taken UNION ALL SELECT * FROM {step}),
last AS (SELECT * FROM w ORDER BY i DESC LIMIT 1),
more AS (SELECT ord, row_number() OVER (ORDER BY ord) AS k FROM e, last WHERE i = (SELECT count(*) FROM n) AND i > 0 AND ready <= i AND NOT list_contains(taken, ord)),
bought AS (SELECT ord, k::BIGINT AS place FROM (SELECT unnest(taken) AS ord, unnest(range(1, len(taken) + 1)) AS k FROM last) UNION ALL SELECT ord, (len(taken) + k)::BIGINT FROM more, last WHERE k <= remaining // 4),
purse AS (SELECT remaining - 4 * (SELECT count(*) FROM more WHERE k <= remaining // 4) AS money, i FROM last),
both_kinds AS (SELECT 'node' AS kind, node_id AS id, rank AS place, np, 0 AS later FROM n, last WHERE rank <= i UNION ALL SELECT 'edge', relationship_id, place, np, 1 FROM bought JOIN e USING (ord)),
summed AS (SELECT *, coalesce(sum(np) OVER (ORDER BY later, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM both_kinds)
SELECT kind, id, place, {kept} AS n_kept FROM summed, purse"""


_SEEDS = ", ".join(f"'{s}'" for s in SEEDS)
EXPAND = _bought_sql(
    40,
    f"SELECT * FROM nodes WHERE node_id NOT IN ({_SEEDS}) AND node_id IN (SELECT a FROM edges WHERE b IN ({_SEEDS}) UNION SELECT b FROM edges WHERE a IN ({_SEEDS}))",
    "SELECT * FROM edges WHERE seq % 7 <> 1",
    f"SELECT unnest([{_SEEDS}]) AS node_id",
    False,
)


def graph_by_parents(spark, d):
    """Plants, their customers and as many of the customers' orders as there is place for."""
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    nodes = n.selectExpr("concat('n', n_nationkey) AS node_id", "'Plant' AS label").union(c.selectExpr("concat('c', c_custkey)", "'Customer'")).union(o.selectExpr("concat('o', o_orderkey)", "'Order'"))
    edges = c.selectExpr("concat('a', c_custkey) AS relationship_id", "concat('n', c_nationkey) AS from_node_id", "concat('c', c_custkey) AS to_node_id").union(o.selectExpr("concat('b', o_orderkey)", "concat('c', o_custkey)", "concat('o', o_orderkey)"))
    found, among = budget.by_parents(nodes, edges, "plant", 3000)
    return found.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("place").cast("long")).union(among.select(F.lit("edge"), "relationship_id", F.lit(None).cast("long")))


def _by_parents_sql(most: int, hops: int) -> str:
    parts, seen = [], "SELECT node_id FROM h0"
    for k in range(1, hops + 1):
        used = f"(SELECT count(*) FROM ({seen}))"
        parts.append(f"""l{k} AS (SELECT b AS node_id, row_number() OVER (ORDER BY rk, a) AS spot FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS rk FROM edges WHERE a IN (SELECT node_id FROM h{k - 1}) AND b IN (SELECT node_id FROM nodes))),
h{k} AS (SELECT node_id, {used} + row_number() OVER (ORDER BY spot) AS place FROM (SELECT node_id, min(spot) AS spot FROM l{k} WHERE spot <= 10 * ({most} - {used}) AND node_id NOT IN ({seen}) GROUP BY 1) QUALIFY place <= {most})""")
        seen += f" UNION ALL SELECT node_id FROM h{k}"
    found = " UNION ALL ".join(f"SELECT node_id, place FROM h{k}" for k in range(hops + 1))
    return f"""WITH nodes AS (SELECT 'n' || n_nationkey AS node_id, 'Plant' AS label FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'Order' FROM orders),
edges AS (SELECT 'a' || c_custkey AS id, 'n' || c_nationkey AS a, 'c' || c_custkey AS b FROM customer UNION ALL SELECT 'b' || o_orderkey, 'c' || o_custkey, 'o' || o_orderkey FROM orders),
h0 AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS place FROM nodes WHERE label = 'Plant'),
{", ".join(parts)},
found AS ({found})
SELECT 'node' AS kind, node_id AS id, place FROM found UNION ALL SELECT 'edge', id, NULL FROM edges WHERE a IN (SELECT node_id FROM found) AND b IN (SELECT node_id FROM found)"""


def surrogate_numbers(spark, d):
    """Orders numbered by price, the dearest first."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return numbering.numbered_whole(o, [F.desc("o_totalprice"), F.col("o_orderkey")]).drop("o_totalprice")


def issue_chains(spark, d):
    """Events as issues of their users; every tenth user is no known equipment."""
    e = table(spark, d, "events").selectExpr(
        "string(event_id) AS row_id",
        "concat(' u', user_id) AS equipment",
        "CASE WHEN user_id % 10 > 0 THEN concat('u', user_id, '#equipment') END AS node_id",
        "CASE WHEN event_id % 97 > 0 THEN event_type ELSE ' ' END AS issue",
        "CASE WHEN event_id % 4 > 0 THEN concat('p', event_id % 4) END AS parameter",
        "CASE WHEN event_id % 3 > 0 THEN concat('c', event_id % 3) ELSE '' END AS cause",
        "CASE WHEN event_id % 5 > 0 THEN concat('k', event_id % 5) ELSE ' ' END AS check",
    )
    nodes, edges = registry.issue_chains(e)
    said = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return nodes.select(F.col("node_id").alias("a"), F.col("label").alias("b"), said.alias("c")).union(edges.select("from_node_id", "rel_type", "to_node_id"))


_STARTS = [("", "row_id"), ("_", "parameter"), ("_", "cause"), ("_", "checked")]
_LEVELS = list(zip(("Issue", "Parameter", "Cause", "Check"), ("HAS_SYMBOLIC", "PARAMETER", "HAS_CAUSE", "HAS_CHECK"), ("issue", "parameter", "cause", "checked")))


def _issues_sql() -> str:
    node = lambda k: "upper(" + " || ".join(f"'{a}' || {b}" for a, b in _STARTS[:k]) + ") || '#symbolic_ai'"
    name = lambda c: "check" if c == "checked" else c
    parts = []
    for k, (label, rel_type, column) in enumerate(_LEVELS, 1):
        said = [f"'{name(column)}=' || {column}", f"'name=' || {column}"] + [f"CASE WHEN depth = {k} AND {c} <> '' THEN '{name(c)}=' || {c} END" for _, _, c in _LEVELS[k:]]
        parts.append(f"SELECT {node(k)} AS a, '{label}' AS b, array_to_string(list_sort(list_filter([{', '.join(said)}], lambda x: x IS NOT NULL)), ';') AS c FROM x WHERE depth >= {k}")
        parts.append(f"SELECT {node(k - 1) if k > 1 else 'equipment_node'}, '{rel_type}', {node(k)} FROM x WHERE depth >= {k}")
    return f"""WITH r AS (SELECT event_id::VARCHAR AS row_id, 'u' || user_id AS equipment, CASE WHEN user_id % 10 > 0 THEN 'u' || user_id || '#equipment' END AS equipment_node, CASE WHEN event_id % 97 > 0 THEN event_type ELSE '' END AS issue,
 CASE WHEN event_id % 4 > 0 THEN 'p' || event_id % 4 ELSE '' END AS parameter, CASE WHEN event_id % 3 > 0 THEN 'c' || event_id % 3 ELSE '' END AS cause, CASE WHEN event_id % 5 > 0 THEN 'k' || event_id % 5 ELSE '' END AS checked FROM events),
g AS (SELECT equipment, issue, parameter, cause, grouping(parameter, cause) AS lvl, count(*) AS n FROM r GROUP BY GROUPING SETS ((equipment, issue), (equipment, issue, parameter), (equipment, issue, parameter, cause))),
x AS (SELECT r.*, CASE WHEN i.n > 1 AND r.parameter <> '' THEN CASE WHEN p.n > 1 AND r.cause <> '' THEN CASE WHEN c.n > 1 AND checked <> '' THEN 4 ELSE 3 END ELSE 2 END ELSE 1 END AS depth
 FROM r JOIN g i ON i.lvl = 3 AND i.equipment = r.equipment AND i.issue = r.issue JOIN g p ON p.lvl = 1 AND p.equipment = r.equipment AND p.issue = r.issue AND p.parameter = r.parameter
 JOIN g c ON c.lvl = 0 AND c.equipment = r.equipment AND c.issue = r.issue AND c.parameter = r.parameter AND c.cause = r.cause WHERE equipment_node IS NOT NULL AND r.issue <> '')
{' UNION ALL '.join(parts)}"""


def registered_nodes(spark, d):
    """Parts as equipment under a few names, from two tables, with edits by hand; nations as plants."""
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    records = p.selectExpr("'Equipment' AS label", "concat(' ', lower(p_brand)) AS key", "'equipment_sap' AS table", "string(p_partkey % 500) AS pk", "concat('pl', p_partkey % 3) AS plant", "concat('sap', p_size % 2) AS source", "p_partkey AS seq", "map('size', string(p_size), 'asset_code', concat('a', p_partkey % 7), 'normalized_asset', IF(p_partkey % 2 = 0, p_type, ' ')) AS properties")
    records = records.union(p.where("p_partkey % 4 = 0").selectExpr("'Equipment'", "p_brand", "'equipment_sap'", "string(p_partkey % 500)", "''", "'pid'", "p_partkey + 1000000000", "map('size', 'pid', 'drawing', string(p_partkey))"))
    records = records.union(n.selectExpr("'Plant'", "n_name", "'plant'", "null", "'x'", "'sap0'", "bigint(n_nationkey)", "map('area', string(n_regionkey))")).union(n.selectExpr("'Sensor'", "n_name", "'timeseries_metadata'", "' '", "'x'", "'ts'", "bigint(n_nationkey)", "map('a', 'b')"))
    edited = p.where("p_partkey % 500 % 9 = 1 and p_partkey < 500").selectExpr("concat(p_partkey % 500, '#equipment_sap') AS node_id", "'size' AS property", "'by hand' AS value")
    nodes, aliases = registry.register(records, edited)
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], "+") if m == "lineage" else x["value"])), ";")
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("label").alias("b"), text("properties").alias("c"), text("lineage").alias("d")).union(aliases.select(F.lit("alias"), "node_id", "label", "alias", "plant"))


REGISTERED = """WITH s AS (
 SELECT 'Equipment' AS label, upper(p_brand) AS key, (p_partkey % 500) || '#equipment_sap' AS node_id, upper('pl' || p_partkey % 3) AS plant, 'sap' || p_size % 2 AS source, p_partkey AS seq, upper('a' || p_partkey % 7) AS code, MAP {'size': p_size::VARCHAR, 'asset_code': 'a' || p_partkey % 7, 'normalized_asset': CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END} AS m FROM part
 UNION ALL SELECT 'Equipment', upper(p_brand), (p_partkey % 500) || '#equipment_sap', '', 'pid', p_partkey + 1000000000, NULL, MAP {'size': 'pid', 'drawing': p_partkey::VARCHAR} FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT 'Plant', upper(n_name), upper(n_name) || '#plant', '', 'sap0', n_nationkey, NULL, MAP {'area': n_regionkey::VARCHAR} FROM nation),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq) = 1),
d AS (SELECT node_id, seq, 0 AS own, source, unnest(['name', 'equipment_id', 'plant_code', 'asset_code']) AS k, unnest([CASE WHEN label = 'Equipment' THEN coalesce(nullif(m['normalized_asset'], ''), key) ELSE key END, CASE WHEN label = 'Equipment' THEN key END, plant, code]) AS v FROM f),
o AS (SELECT node_id, seq, 1 AS own, source, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM s),
a AS (SELECT * FROM (FROM d UNION ALL FROM o) WHERE coalesce(v, '') <> ''),
e AS (SELECT DISTINCT (p_partkey % 500) || '#equipment_sap' AS node_id FROM part WHERE p_partkey % 500 % 9 = 1 AND p_partkey < 500),
src AS (SELECT node_id, k, source, min((seq, own)) AS spot FROM a GROUP BY ALL),
lin AS (SELECT node_id, k, string_agg(source, '+' ORDER BY spot) AS lineage FROM src GROUP BY ALL),
p AS (SELECT node_id, k, arg_max(v, (seq, own)) AS v, lineage FROM a JOIN lin USING (node_id, k) GROUP BY node_id, k, lineage),
q AS (SELECT * FROM p WHERE NOT (k = 'size' AND node_id IN (FROM e)) UNION ALL SELECT node_id, 'size', 'by hand', 'ui_update' FROM e WHERE node_id IN (SELECT node_id FROM f)),
names AS (SELECT DISTINCT node_id, label, unnest(CASE WHEN label = 'Equipment' THEN [key, code] ELSE [key] END) AS alias, plant FROM f)
SELECT 'node' AS kind, node_id AS a, label AS b, string_agg(k || '=' || v, ';' ORDER BY k) AS c, string_agg(k || '=' || lineage, ';' ORDER BY k) AS d FROM q JOIN f USING (node_id) GROUP BY node_id, label
UNION ALL SELECT 'alias', node_id, label, alias, plant FROM names WHERE alias IS NOT NULL"""


QUERIES = {
    "graph_sample": (graph_sample, _bought_sql(200)),
    "graph_sample_rich": (graph_sample_rich, _bought_sql(1000)),
    "graph_sample_poor": (graph_sample_poor, _bought_sql(7)),
    "graph_expand_budget": (graph_expand_budget, EXPAND),
    "graph_by_parents": (graph_by_parents, _by_parents_sql(3000, 2)),
    "surrogate_numbers": (surrogate_numbers, "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS uid FROM orders"),
    "issue_chains": (issue_chains, _issues_sql()),
    "registered_nodes": (registered_nodes, REGISTERED),
}
