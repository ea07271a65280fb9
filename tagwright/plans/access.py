"""Queries that pick, page, count and check rows, and those on JSON columns, nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.functions import coerce, nested
from tagwright.operators import filters, gates, graph
from tagwright.plans.assets import EDGES, edges
from tagwright.plans.series import table

PROPS = "concat('{\"tag_name\":\"T-', p_partkey, '\",\"maker\":\"', p_brand, '\",\"src\":\"', CASE WHEN p_size % 4 = 0 THEN 'ui_update' ELSE 'sap' END, '\"}')"


def parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", F.expr(PROPS).alias("props"))


def batch_filter(spark, d):
    return filters.in_batch(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "1, 4,7 ,,22,100")


def file_set_filter(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("concat('in\\\\x/', upper(p_brand), ' v', p_size, '.PDF')").alias("source_file"))
    f = table(spark, d, "part").where("p_size % 5 = 0").select(F.expr("concat(p_brand, '_V', p_size, '.xlsx')").alias("name"))
    return filters.in_files(p, "source_file", f, "name").select("p_partkey")


FILE_SET = "WITH k AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size % 5 = 0) SELECT p_partkey FROM part SEMI JOIN k USING (p_brand, p_size)"


def time_range(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("CASE WHEN event_id % 2 = 0 THEN event_id * 1000 ELSE event_id END").alias("t"))
    return filters.between(e, "t", 100_000, 300_000)


def relative_window(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return filters.since(e, "s", "last 2 hours").select("event_id")


def log_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("CASE WHEN value > 90 THEN 'error' ELSE 'INFO' END").alias("level"), F.concat(F.lit("Got "), "event_type").alias("message"))
    return filters.log_rows(e, "ERROR", "got C").select("event_id")


def json_property_filter(spark, d):
    p = parts(spark, d)
    return filters.with_property(p.where(nested.json_contains("props", {"src": "sap"}) | nested.any_value("props", "ui_update")), "props", "tag_name", "t-1").select("p_partkey", nested.any_value("props", "ui_update").alias("by_person"))


def meaningful(spark, d):
    p = table(spark, d, "part").select(F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN ' ' END").alias("a"), F.lit(None).cast("string").alias("b"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_size END").alias("c"))
    return filters.meaningful(p)


def excluded_types(spark, d):
    return filters.without_types(table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_brand").alias("kind")), "kind", ["brand#11", "BRAND#12 ", "BRAND#23"]).select("p_partkey")


def review_split(spark, d):
    sure, low = filters.for_review(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / 50 END").alias("confidence")), "confidence")
    return sure.groupBy().agg(F.count("*").alias("n")).select(F.lit("sure").alias("part"), "n").union(low.groupBy().agg(F.count("*").alias("n")).select(F.lit("review"), "n"))


def page_envelope(spark, d):
    rows, total = filters.numbered_page(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name"), ["c_custkey"], 2, 10)
    return rows.join(F.broadcast(total))


def latest_rows(spark, d):
    return filters.latest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15, ["o_orderkey"])


def emptiest_columns(spark, d):
    o = table(spark, d, "orders").select(*[F.expr(f"CASE WHEN o_orderkey % {k} = 0 THEN o_custkey END").alias(f"c{k}") for k in range(2, 14)])
    return filters.emptiest(o)


def violation_samples(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_quantity")
    return filters.first_violations(li, "l_returnflag", "l_partkey", F.col("l_quantity") > 40).select("l_returnflag", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


def value_counts(spark, d):
    return filters.counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def purge_preview(spark, d):
    named = {"supplier": table(spark, d, "supplier").withColumnRenamed("s_nationkey", "plant"), "customer": table(spark, d, "customer").withColumnRenamed("c_nationkey", "plant"), "part": table(spark, d, "part")}
    return filters.preview(named, "plant", 3)


def daily_summary(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.expr("CASE WHEN value > 90 THEN 'error' WHEN value > 70 THEN 'warning' ELSE 'info' END").alias("level"))
    return e.groupBy("day").agg(*[F.count_if(F.col("level") == k).alias(k) for k in ("error", "warning", "info")]).withColumn("day", F.col("day").cast("string"))


def list_fields(spark, d):
    raw = F.expr("""CASE p_partkey % 4 WHEN 0 THEN concat('["', p_brand, '", " b ", "', p_brand, '"]') WHEN 1 THEN concat(p_brand, ', ,x,', p_brand) WHEN 2 THEN concat('[', p_size, ',') ELSE NULL END""")
    p = table(spark, d, "part").select("p_partkey", nested.as_list(raw).alias("v"), F.create_map(F.lit("b"), F.col("p_brand"), F.lit("a"), F.expr("CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_type END")).alias("m"))
    return p.select("p_partkey", F.array_join("v", "|").alias("items"), nested.described("m").alias("described"))


LIST_FIELDS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '|b' WHEN 1 THEN p_brand || '|x' WHEN 2 THEN '[' || p_size ELSE '' END AS items, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'a: ' || trim(p_type) || ' | ' END || 'b: ' || p_brand AS described FROM part"


def parallel_unnest(spark, d):
    c = table(spark, d, "customer").where("c_custkey <= 50").select("c_custkey", F.expr("sequence(1, 1 + c_custkey % 3)").alias("a"), F.expr("sequence(10, 11)").alias("b"))
    return c.select("c_custkey", F.explode(nested.pairs("a", "b")).alias("p")).select("c_custkey", "p.*")


PARALLEL = "WITH c AS (SELECT c_custkey, range(1, 2 + c_custkey % 3) AS a, [10, 11] AS b FROM customer WHERE c_custkey <= 50) SELECT c_custkey, generate_subscripts(a, 1) AS place, unnest(a) AS first, NULL AS second FROM c WHERE FALSE UNION ALL SELECT c_custkey, i AS place, a[i] AS first, b[i] AS second FROM c, range(1, 4) t(i) WHERE i <= greatest(len(a), len(b))"


def typed_values(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 5 WHEN 0 THEN '1,200' WHEN 1 THEN '12.5' WHEN 2 THEN 'Yes' WHEN 3 THEN 'f' ELSE ' ' END").alias("v"))
    return p.select("p_partkey", coerce.limit_of_type("v", "INTEGER").alias("i"), coerce.limit_of_type("v", "NUMERIC(18,6)").alias("n"), coerce.limit_of_type("v", "BOOLEAN").alias("b"), coerce.limit_of_type("v", "VARCHAR(9)").alias("s"))


TYPED = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1200 END AS i, CASE p_partkey % 5 WHEN 0 THEN 1200.0 WHEN 1 THEN 12.5 END::DOUBLE AS n, CASE p_partkey % 5 WHEN 2 THEN TRUE WHEN 3 THEN FALSE END AS b,
 CASE p_partkey % 5 WHEN 0 THEN '1,200' WHEN 1 THEN '12.5' WHEN 2 THEN 'Yes' WHEN 3 THEN 'f' END AS s FROM part"""


def day_first_times(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey < 4 THEN ' ' WHEN o_orderkey % 7 = 0 THEN '31.31.2020' ELSE date_format(o_orderdate, 'd/M/yyyy') END").alias("t"))
    iso = table(spark, d, "orders").select("o_orderkey", F.expr("date_format(o_orderdate, 'yyyy-MM-dd')").alias("t2"))
    read = coerce.series_timestamp(o, "t", "o_orderkey", "ts").join(coerce.series_timestamp(iso, "t2", "o_orderkey", "ts2"), "o_orderkey")
    return read.select("o_orderkey", F.unix_millis("ts").alias("ms"), F.unix_millis("ts2").alias("ms2"))


DAY_FIRST = "SELECT o_orderkey, CASE WHEN o_orderkey >= 4 AND o_orderkey % 7 <> 0 THEN epoch_ms(o_orderdate::DATE::TIMESTAMP) END AS ms, epoch_ms(o_orderdate::DATE::TIMESTAMP) AS ms2 FROM orders"


def header_gate(spark, d):
    return gates.headers(table(spark, d, "nation"), ["n_nationkey", "n_name", "n_code"])


def contract_check(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.lit(None).cast("string").alias("s_note"))
    return gates.contract(s, "supplier", ["s_suppkey", "s_note", "s_city"]).union(gates.contract(s.where("false"), "empty", ["s_suppkey"])).union(gates.contract(s, "open", [])).union(gates.contract(s, "good", ["s_suppkey"], 0.1))


CONTRACT = """SELECT 'supplier' AS dataset, count(*) AS n_rows, 'missing required columns: s_city; s_note is 100% null, at or over the 100% limit' AS problems, 'FAIL' AS status FROM supplier UNION ALL SELECT 'empty', 0, 'produced 0 rows', 'FAIL'
UNION ALL SELECT 'open', count(*), 'no contract for this dataset, so nothing was checked', 'FAIL' FROM supplier UNION ALL SELECT 'good', count(*), '', 'PASS' FROM supplier"""


def relationship_duplicates(spark, d):
    return gates.repeated_relationships(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


def schema_coverage(spark, d):
    return gates.coverage({"part": table(spark, d, "part"), "nation": table(spark, d, "nation")}, {"part": ["p_partkey", "p_name", "p_color"], "nation": ["n_name"], "site": ["id", "name"]})


def metadata_report(spark, d):
    t = lambda where: table(spark, d, "customer").where(where).select(F.concat(F.lit("t"), "c_custkey").alias("tag"))
    return gates.metadata_report(t("c_custkey % 3 > 0"), t("c_custkey % 4 > 0"), "tag")


def nodes(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_name").alias("name"), F.lit("Plant").alias("label"), F.expr("concat('{\"equipment_id\":\"Q', n_nationkey, '\"}')").alias("properties"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.lit("Equipment").alias("label"), F.expr("concat('{\"tag_name\":\"q', s_suppkey, '\"}')").alias("properties"))
    return n.union(s)


NODES = "nd AS (SELECT 'n' || n_nationkey AS node_id, n_name AS name, 'Plant' AS label, 'Q' || n_nationkey AS eq, NULL AS tag FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'Equipment', NULL, 'q' || s_suppkey FROM supplier)"


def node_search(spark, d):
    return graph.search(nodes(spark, d), "q1", 10)


NODE_SEARCH = f"WITH {NODES} SELECT node_id, name, label, CASE WHEN lower(coalesce(eq, tag)) = 'q1' THEN 1 ELSE 0 END AS is_exact FROM nd WHERE contains(lower(name), 'q1') OR contains(lower(tag), 'q1') OR contains(lower(eq), 'q1') ORDER BY is_exact DESC, name, node_id LIMIT 10"


def linked_nodes(spark, d):
    return graph.linked(edges(spark, d), nodes(spark, d), "r1", "Plant").select("node_id", "rel_type", "name")


LINKED = f"WITH {EDGES}, {NODES} SELECT DISTINCT node_id, rel_type, name FROM e JOIN nd ON node_id = from_node_id WHERE to_node_id = 'r1' AND label = 'Plant'"


def tags_of_equipment(spark, d):
    e = edges(spark, d).where("from_node_id like 's%'").withColumn("rel_type", F.lit("HAS_TAG"))
    return graph.tags_of(e, nodes(spark, d))


def frontier(spark, d):
    front = spark.createDataFrame([("s1",), ("r2",)], "node_id string")
    return graph.expand(edges(spark, d), front, 2).withColumn("hop", F.col("hop").cast("long"))


FRONTIER = f"""WITH RECURSIVE {EDGES}, w AS (SELECT from_node_id AS a, to_node_id AS b FROM e UNION SELECT to_node_id, from_node_id FROM e), f AS (SELECT unnest(['s1', 'r2']) AS node_id, 0::BIGINT AS hop UNION ALL SELECT b, hop + 1 FROM f JOIN w ON a = node_id WHERE hop < 2)
SELECT node_id, min(hop) AS hop FROM f GROUP BY 1"""


def node_changes(spark, d):
    stored = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("n"), "p_partkey").alias("node_id"), F.create_map(F.lit("a"), "p_brand", F.lit("b"), F.lit("old")).alias("properties"))
    c = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("n"), "p_partkey").alias("node_id"), F.expr("CASE p_partkey % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'delete_property' ELSE 'upsert' END").alias("op"), F.lit(1).alias("seq"), F.create_map(F.lit("b"), F.lit("new")).alias("properties"), F.lit("a").alias("property"))
    late = table(spark, d, "part").where("p_partkey % 30 = 0").select(F.concat(F.lit("n"), "p_partkey").alias("node_id"), F.lit("upsert").alias("op"), F.lit(2).alias("seq"), F.create_map(F.lit("c"), F.lit("x")).alias("properties"), F.lit("a").alias("property"))
    out = graph.apply_changes(stored, c.union(late))
    return out.select("node_id", *[F.try_element_at("properties", F.lit(k)).alias(k) for k in "abc"])


NODE_CHANGES = """WITH p AS (SELECT p_partkey AS k, p_brand, k % 2 = 0 AS stored, k % 3 = 0 AS changed, CASE k % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'delete_property' ELSE 'upsert' END AS op FROM part)
SELECT 'n' || k AS node_id, CASE WHEN stored AND NOT (changed AND op <> 'upsert') THEN p_brand END AS a, CASE WHEN changed AND op = 'upsert' THEN 'new' WHEN stored AND NOT (changed AND op = 'delete') THEN 'old' END AS b, CASE WHEN k % 30 = 0 THEN 'x' END AS c
FROM p WHERE k % 30 = 0 OR (stored AND NOT (changed AND op = 'delete')) OR (changed AND op = 'upsert')"""


def equipment_lookup(spark, d):
    e = table(spark, d, "supplier").selectExpr("concat('s', s_suppkey) AS node_id", "concat('e', s_suppkey % 4) AS key", "CASE s_suppkey % 3 WHEN 0 THEN '' ELSE concat('P', s_suppkey % 3) END AS plant", "s_suppkey AS seq")
    a = table(spark, d, "customer").selectExpr("c_custkey", "concat(' E', c_custkey % 5) AS key", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('p', c_custkey % 4) END AS plant")
    return graph.find_equipment(a, e).select("c_custkey", "node_id")


EQUIPMENT_LOOKUP = """WITH e AS (SELECT 's' || s_suppkey AS node_id, 'E' || s_suppkey % 4 AS k, CASE s_suppkey % 3 WHEN 0 THEN '' ELSE 'P' || s_suppkey % 3 END AS p, s_suppkey AS seq FROM supplier), a AS (SELECT c_custkey, 'E' || c_custkey % 5 AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'P' || c_custkey % 4 END AS p FROM customer)
SELECT c_custkey, coalesce((SELECT arg_min(node_id, seq) FROM e WHERE e.k = a.k AND e.p = a.p), (SELECT arg_min(node_id, seq) FROM e WHERE e.k = a.k AND e.p = ''), (SELECT arg_min(node_id, seq) FROM e WHERE e.k = a.k)) AS node_id FROM a"""

QUERIES = {
    "batch_filter": (batch_filter, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 4, 7, 22, 100)"),
    "file_set_filter": (file_set_filter, FILE_SET),
    "time_range": (time_range, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 1000 ELSE event_id END AS t FROM events WHERE event_id BETWEEN 100 AND 300 OR t BETWEEN 100000 AND 300000"),
    "relative_window": (relative_window, "SELECT event_id FROM events WHERE epoch_ms(ts) // 1000 > (SELECT max(epoch_ms(ts) // 1000) FROM events) - 7200"),
    "log_filter": (log_filter, "SELECT event_id FROM events WHERE value > 90 AND starts_with(lower(event_type), 'c')"),
    "json_property_filter": (json_property_filter, "SELECT p_partkey, p_size % 4 = 0 AS by_person FROM part WHERE starts_with(p_partkey::VARCHAR, '1')"),
    "meaningful_rows": (meaningful, "SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN ' ' END AS a, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS c FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0"),
    "excluded_types": (excluded_types, "SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#23')"),
    "review_split": (review_split, "SELECT CASE WHEN l_linenumber <> 3 AND l_quantity / 50 >= 0.8 THEN 'sure' ELSE 'review' END AS part, count(*) AS n FROM lineitem GROUP BY 1"),
    "page_envelope": (page_envelope, "WITH t AS (SELECT count(*) AS total FROM customer WHERE c_acctbal > 0) SELECT c_custkey, c_name, total, ceil(total / 10)::BIGINT AS total_pages, 2 AS page FROM customer, t WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 10 OFFSET 10"),
    "latest_rows": (latest_rows, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15"),
    "emptiest_columns": (emptiest_columns, " UNION ALL ".join(f"SELECT 'c{k}' AS \"column\", round(count(*) FILTER (o_orderkey % {k} <> 0) / count(*), 6) AS null_share FROM orders" for k in range(2, 14)) + " ORDER BY null_share DESC, \"column\" LIMIT 10"),
    "violation_samples": (violation_samples, "WITH v AS (SELECT l_returnflag, l_partkey FROM lineitem WHERE l_quantity > 40) SELECT l_returnflag, count(*) AS n, array_to_string(list_sort(list_distinct(list(l_partkey)))[1:5], ',') AS samples FROM v GROUP BY 1"),
    "value_counts": (value_counts, "SELECT 'o_orderstatus' AS column, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2"),
    "purge_preview": (purge_preview, "SELECT 'supplier' AS table, count(*) AS n FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey = 3"),
    "daily_summary": (daily_summary, "SELECT ts::DATE::VARCHAR AS day, count(*) FILTER (value > 90) AS error, count(*) FILTER (value > 70 AND value <= 90) AS warning, count(*) FILTER (value <= 70 OR value IS NULL) AS info FROM events GROUP BY 1"),
    "list_fields": (list_fields, LIST_FIELDS),
    "parallel_unnest": (parallel_unnest, PARALLEL),
    "typed_values": (typed_values, TYPED),
    "day_first_times": (day_first_times, DAY_FIRST),
    "header_gate": (header_gate, "SELECT 'n_code' AS missing, 'n_regionkey' AS extra, 'BLOCK' AS status"),
    "contract_check": (contract_check, CONTRACT),
    "relationship_duplicates": (relationship_duplicates, "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING n > 1) SELECT count(*) AS relationships, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows, CASE WHEN coalesce(sum(n - 1), 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM g"),
    "schema_coverage": (schema_coverage, "SELECT * FROM (VALUES ('part', 3, 2, 66.67::DOUBLE), ('nation', 1, 1, 100.0), ('site', 2, 0, 0.0)) t(\"table\", declared, present, coverage_pct)"),
    "metadata_report": (metadata_report, "SELECT 't' || c_custkey AS tag, CASE WHEN c_custkey % 3 > 0 THEN 'missing' ELSE 'extra' END AS state FROM customer WHERE (c_custkey % 3 > 0) <> (c_custkey % 4 > 0)"),
    "node_search": (node_search, NODE_SEARCH),
    "linked_nodes": (linked_nodes, LINKED),
    "tags_of_equipment": (tags_of_equipment, "SELECT DISTINCT s_name AS equipment, n_name AS tag FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "graph_frontier": (frontier, FRONTIER),
    "node_changes": (node_changes, NODE_CHANGES),
    "equipment_lookup": (equipment_lookup, EQUIPMENT_LOOKUP),
}
