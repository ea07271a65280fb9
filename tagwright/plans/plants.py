"""Queries on whole stars of tables, layered configuration, relationships by definition, the series ladder and gates that read rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.operators import config, gates, joins, ladder, relations, stars
from tagwright.plans.series import table


def sap_tables(spark, d):
    """The given tables under the names and columns of work orders, operations, notes, costs and equipment."""
    t = lambda name, *columns: table(spark, d, name).selectExpr(*columns)
    return {
        "AUFK": t("orders", "string(o_orderkey) AS AUFNR", "string(o_custkey) AS EQUNR", "o_orderstatus AS STATUS", "o_orderkey AS seq"),
        "AFKO": t("orders", "concat(o_orderkey, '.0') AS AUFNR", "concat('k', o_orderkey) AS AUFPL", "o_orderpriority AS STATUS", "o_orderkey AS seq"),
        "AFVC": t("lineitem", "string(l_orderkey) AS AUFNR", "string(l_partkey) AS AUFPL", "string(l_linenumber) AS VORNR", "string(l_suppkey) AS ARBID", "l_partkey * 1000000000 + l_suppkey AS seq"),
        "AFVV": t("part", "string(p_partkey) AS AUFPL", "'1' AS VORNR", "p_size AS DAUNO_MIN", "p_partkey AS seq"),
        "QMEL": t("events", "string(event_id % 5000) AS AUFNR", "string(event_id % 777) AS QMNUM", "event_id AS seq"),
        "QMSM": t("events", "string(event_id % 900) AS QMNUM", "event_type AS MNCOD", "-event_id AS seq"),
        "JEST": t("lineitem", "concat('OR', l_orderkey) AS OBJNR", "l_linestatus AS STAT", "l_linenumber * 1000000000000 + l_partkey AS seq"),
        "COEP": t("lineitem", "string(l_orderkey) AS AUFNR", "int(l_quantity) AS WTGBTR", "l_linenumber * 1000000000000 + l_partkey AS seq"),
        "EQUI": t("customer", "string(c_custkey) AS EQUNR", "string(c_nationkey) AS TPLNR", "c_mktsegment AS STATUS", "c_custkey AS seq"),
        "IFLOT": t("nation", "string(n_nationkey) AS TPLNR", "n_name AS PLTXT", "n_nationkey AS seq"),
        "STXH": t("customer", "IF(c_custkey % 2 = 0, 'AUFK', 'QMEL') AS TDOBJECT", "string(c_custkey) AS TDNAME", "c_name AS TDID", "c_custkey AS seq"),
    }


def work_order_star(spark, d):
    """Ten tables around orders, a row for each order and line; costs summed before they meet them."""
    return stars.work_orders(sap_tables(spark, d)).withColumns({"DAUNO_MIN": F.col("DAUNO_MIN").cast("long"), "WTGBTR": F.col("WTGBTR").cast("long")})


WORK_ORDER_STAR = """WITH op AS (SELECT l_orderkey AS k, l_linenumber AS v, arg_min(l_suppkey, l_partkey) AS arbid, arg_min(l_partkey, l_partkey) AS aufpl FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2),
q AS (SELECT event_id % 5000 AS k, (arg_min(event_id, event_id) % 777)::VARCHAR AS qmnum FROM events GROUP BY 1),
m AS (SELECT (event_id % 900)::VARCHAR AS qmnum, arg_max(event_type, event_id) AS mncod FROM events GROUP BY 1),
j AS (SELECT l_orderkey AS k, arg_min(l_linestatus, (l_linenumber, l_partkey, l_linestatus)) AS stat, sum(l_quantity::INT)::BIGINT AS cost FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS "AUFNR", o_custkey::VARCHAR AS "EQUNR", o_orderstatus AS "STATUS", 'OR' || o_orderkey AS "OBJNR", 'k' || o_orderkey AS "AUFPL", o_orderpriority AS "STATUS_r", op.v::VARCHAR AS "VORNR", arbid::VARCHAR AS "ARBID",
 CASE WHEN op.v = 1 THEN p_size END::BIGINT AS "DAUNO_MIN", q.qmnum AS "QMNUM", mncod AS "MNCOD", stat AS "STAT", cost AS "WTGBTR", c.c_nationkey::VARCHAR AS "TPLNR", c.c_mktsegment AS "STATUS_EQUI", n_name AS "PLTXT", x.c_name AS "TDID"
FROM orders LEFT JOIN op ON op.k = o_orderkey LEFT JOIN part ON p_partkey = aufpl LEFT JOIN q ON q.k = o_orderkey LEFT JOIN m ON m.qmnum = q.qmnum LEFT JOIN j ON j.k = o_orderkey
LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c.c_nationkey LEFT JOIN customer x ON x.c_custkey = o_orderkey AND x.c_custkey % 2 = 0"""


def material_totals(spark, d):
    """Parts with their suppliers as plants; reservations and costs of their orders, summed without their product."""
    t = lambda name, *columns: table(spark, d, name).selectExpr(*columns)
    li = ("string(l_partkey) AS MATNR", "string(l_orderkey % 997) AS AUFNR", "int(l_quantity) AS BDMNG", "l_orderkey * 10 + l_linenumber AS seq")
    tables = {
        "MARA": t("part", "string(p_partkey) AS MATNR", "p_brand AS MTART", "p_partkey AS seq"),
        "MARC": t("part", "string(p_partkey) AS MATNR", "string(p_size % 3) AS WERKS", "p_type AS EKGRP", "p_partkey AS seq").where("MATNR % 5 > 0"),
        "MARD": t("lineitem", "string(l_partkey) AS MATNR", "string(l_suppkey % 3) AS WERKS", "l_returnflag AS LGORT", "l_orderkey * 10 + l_linenumber AS seq").where("seq % 7 = 0"),
        "RESB": t("lineitem", *li),
        "COEP": t("orders", "string(o_orderkey % 1500) AS AUFNR", "int(o_totalprice) AS WTGBTR", "o_orderkey AS seq"),
    }
    out = stars.materials(tables, ["BDMNG"], ["WTGBTR"])
    return out.select("MATNR", "WERKS", "MTART", "EKGRP", *[F.col(c).cast("decimal(38,0)").cast("string").alias(c) for c in ("BDMNG", "WTGBTR")])


MATERIAL_TOTALS = """WITH l AS (SELECT o_orderkey % 1500 AS a, count(*) AS n, sum(o_totalprice::INT::HUGEINT) AS w FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders) GROUP BY 1),
h AS (SELECT l_partkey AS m, l_orderkey % 997 AS a, trunc(l_quantity)::INT AS b FROM lineitem),
s AS (SELECT m, sum(b::HUGEINT * coalesce(n, 1)) AS b, sum(w) AS w FROM h LEFT JOIN l USING (a) GROUP BY 1),
d AS (SELECT l_partkey AS m, l_suppkey % 3 AS p, count(*) AS n FROM lineitem WHERE (l_orderkey * 10 + l_linenumber) % 7 = 0 GROUP BY 1, 2)
SELECT p_partkey::VARCHAR AS "MATNR", CASE WHEN p_partkey % 5 > 0 THEN (p_size % 3)::VARCHAR END AS "WERKS", p_brand AS "MTART", CASE WHEN p_partkey % 5 > 0 THEN p_type END AS "EKGRP",
 (s.b * CASE WHEN p_partkey % 5 > 0 THEN coalesce(d.n, 1) ELSE 1 END)::VARCHAR AS "BDMNG", (s.w * CASE WHEN p_partkey % 5 > 0 THEN coalesce(d.n, 1) ELSE 1 END)::VARCHAR AS "WTGBTR"
FROM part LEFT JOIN s ON s.m = p_partkey LEFT JOIN d ON d.m = p_partkey AND d.p = p_size % 3"""


def config_layers(spark, d):
    """Settings of parts in three layers, each a few levels deep."""
    p = table(spark, d, "part")
    base = p.selectExpr("p_partkey AS key", "1 AS layer", "concat('{\"a\": {\"b\": {\"c\": {\"d\": ', p_size, ', \"e\": \"', p_brand, '\"}}, \"f\": [1, 2]}, \"g\": 1}') AS doc")
    site = p.where("p_partkey % 2 = 0").selectExpr("p_partkey", "2", "CASE p_partkey % 6 WHEN 0 THEN '{\"a\": {\"b\": {\"c\": {\"d\": -1}}}}' WHEN 2 THEN '{\"a\": {\"b\": 7}}' ELSE '{\"g\": {\"h\": {\"i\": 1}}}' END")
    plant = p.where("p_partkey % 3 = 0").selectExpr("p_partkey", "3", "CASE p_partkey % 4 WHEN 0 THEN concat('{\"a\": {\"f\": [', p_size, ']}, \"g\": {\"h\": {\"j\": 2}}}') WHEN 2 THEN '{\"a\": {\"b\": {\"k\": {}}}}' ELSE '{\"a\": 0}' END")
    merged = config.deep_merged(base.union(site).union(plant))
    at = lambda path: F.get_json_object("doc", f"$.{path}")
    return merged.select("key", *[F.when(F.startswith(at(p), F.lit("{")), "object").otherwise(at(p)).alias(p.replace(".", "_")) for p in CONFIG_PATHS])


CONFIG_PATHS = ("a", "a.b", "a.b.c.d", "a.b.c.e", "a.b.k", "a.f", "g", "g.h.i", "g.h.j")
_PATCHES = """WITH p AS (SELECT p_partkey AS key, '{"a":{"b":{"c":{"d":' || p_size || ',"e":"' || p_brand || '"}},"f":[1,2]},"g":1}' AS base,
 CASE WHEN p_partkey % 2 > 0 THEN '{}' WHEN p_partkey % 6 = 0 THEN '{"a":{"b":{"c":{"d":-1}}}}' WHEN p_partkey % 6 = 2 THEN '{"a":{"b":7}}' ELSE '{"g":{"h":{"i":1}}}' END AS site,
 CASE WHEN p_partkey % 3 > 0 THEN '{}' WHEN p_partkey % 4 = 0 THEN '{"a":{"f":[' || p_size || ']},"g":{"h":{"j":2}}}' WHEN p_partkey % 4 = 2 THEN '{"a":{"b":{"k":{}}}}' ELSE '{"a":0}' END AS plant FROM part),
m AS (SELECT key, json_merge_patch(json_merge_patch(base::JSON, site::JSON), plant::JSON) AS doc FROM p)
"""
CONFIG_LAYERS = _PATCHES + "SELECT key, " + ", ".join(f"CASE WHEN json_type(doc, '$.{p}') = 'OBJECT' THEN 'object' ELSE json_extract_string(doc, '$.{p}') END AS {p.replace('.', '_')}" for p in CONFIG_PATHS) + " FROM m"


def all_relationships(spark, d):
    """Orders and purchases by the model's own definitions."""
    t = lambda name, *columns: table(spark, d, name).selectExpr(*columns)
    plant = "concat('P', {} % 3) AS plant_code_id".format
    seq = "(l_orderkey * 100 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey AS seq"
    sources = {
        "sap_po": t("lineitem", plant("l_suppkey"), "string(l_orderkey) AS po_number", "string(l_linenumber) AS po_item", "concat(' ', l_suppkey) AS vendor_code", "string(l_partkey) AS material_code", "l_discount AS confidence", seq),
        "sap_wo": t("orders", plant("o_orderkey"), "string(o_orderkey) AS wo_number", "concat('c', o_custkey) AS asset", "IF(o_orderkey % 2 = 0, concat('r', o_orderkey), 'nan') AS source_record_id", "o_orderkey AS seq"),
    }
    tables = {
        "purchase_order": t("lineitem", "string(l_orderkey) AS po_number", "string(l_linenumber) AS po_item", "concat('po', l_orderkey, '.', l_linenumber) AS po_uid", "l_orderkey AS seq"),
        "vendor": t("supplier", "string(s_suppkey) AS vendor_code", "IF(s_suppkey % 4 > 0, s_name, null) AS vendor_uid", "s_suppkey AS seq"),
        "material": t("part", "string(p_partkey) AS material_code", "concat('m', p_partkey) AS material_uid", "p_partkey AS seq"),
        "work_order": t("orders", plant("o_orderkey"), "string(o_orderkey) AS wo_number", "concat('w', o_orderkey) AS wo_uid", "o_orderkey AS seq"),
        "equipment": t("customer", plant("c_custkey"), "concat('c', c_custkey) AS normalized_asset", "c_name AS equipment_uid", "c_custkey AS seq"),
    }
    e = relations.Entity
    entities = {"purchase_order": e(("po_number", "po_item"), "po_uid"), "vendor": e(("vendor_code",), "vendor_uid"), "material": e(("material_code",), "material_uid"), "work_order": e(("plant_code_id", "wo_number"), "wo_uid"), "equipment": e(("plant_code_id", "normalized_asset"), "equipment_uid", {"normalized_asset": {"sap_wo": "asset"}})}
    return relations.relationships(sources, entities, tables)


ALL_RELATIONSHIPS = """WITH l AS (SELECT *, 'P' || l_suppkey % 3 AS plant, 'po' || l_orderkey || '.' || l_linenumber AS po FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, l_suppkey, min(plant) AS plant, min(po) AS po, arg_min(l_discount, (l_partkey, l_discount)) AS c FROM l GROUP BY 1, 2, 3),
m AS (SELECT l_orderkey, l_linenumber, l_partkey, arg_min(plant, (l_suppkey, l_discount)) AS plant, min(po) AS po, arg_min(l_discount, (l_suppkey, l_discount)) AS c FROM l GROUP BY 1, 2, 3),
r AS (SELECT plant, po AS a, s_name AS b, 'PURCHASED_FROM' AS t, 'sap_po_po_to_vendor:' || sha1(l_orderkey || '|' || l_linenumber || '|' || l_suppkey) AS record, c FROM v JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 4 > 0
 UNION ALL SELECT plant, po, 'm' || l_partkey, 'ORDERS_MATERIAL', 'sap_po_po_to_material:' || sha1(l_orderkey || '|' || l_linenumber || '|' || l_partkey), c FROM m JOIN part ON p_partkey = l_partkey
 UNION ALL SELECT 'P' || o_orderkey % 3, 'w' || o_orderkey, c_name, 'EXECUTED_ON', CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey ELSE 'sap_wo_wo_to_equipment:' || sha1('P' || o_orderkey % 3 || '|' || o_orderkey || '|') END, 0.8 FROM orders JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = o_orderkey % 3)
SELECT DISTINCT 'rel:' || sha1(plant || '|' || t || '|' || a || '|' || b) AS relationship_uid, plant AS plant_code_id, a AS parent_ref, b AS child_ref, t AS relationship_type, 'SAP' AS source_system, record AS source_record_id, c AS confidence FROM r"""


def foreign_keys(spark, d):
    """Eight references at once; one parent has less than half, one table is not there."""
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    t |= {"part": table(spark, d, "part").where("p_size > 10"), "few": table(spark, d, "part").where("p_size > 40"), "region": table(spark, d, "region").where("r_regionkey < 4")}
    keys = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_partkey", "few", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_sitekey", "nation", "n_nationkey"), ("orders", "o_orderkey", "site", "id"))
    return relations.unresolved(t, keys)


def _foreign_key_sql(child: str, column: str, parent: str, other: str, rows: str) -> str:
    return f"""SELECT '{child}' AS child, '{column}' AS "column", '{parent}' AS parent, count(*) AS referring, count(*) FILTER (p.k IS NULL) AS unresolved, round(count(*) FILTER (p.k IS NULL) / count(*) * 100, 2) AS unresolved_pct, CASE WHEN round(count(*) FILTER (p.k IS NULL) / count(*) * 100, 2) > 50 THEN 'WARN' ELSE 'PASS' END AS status FROM {child} LEFT JOIN (SELECT DISTINCT {other} AS k FROM {rows}) p ON p.k = {column}"""


FOREIGN_KEYS = " UNION ALL ".join(
    [
        _foreign_key_sql("lineitem", "l_orderkey", "orders", "o_orderkey", "orders"),
        _foreign_key_sql("lineitem", "l_partkey", "part", "p_partkey", "part WHERE p_size > 10"),
        _foreign_key_sql("lineitem", "l_partkey", "few", "p_partkey", "part WHERE p_size > 40"),
        _foreign_key_sql("lineitem", "l_suppkey", "supplier", "s_suppkey", "supplier"),
        _foreign_key_sql("orders", "o_custkey", "customer", "c_custkey", "customer"),
        _foreign_key_sql("nation", "n_regionkey", "region", "r_regionkey", "region WHERE r_regionkey < 4"),
        "SELECT 'orders', 'o_sitekey', 'nation', 0, 0, 0.0, 'SKIPPED'",
        "SELECT 'orders', 'o_orderkey', 'site', 0, 0, 0.0, 'SKIPPED'",
    ]
)


def series_ladder(spark, d):
    """Tags of parts on every rung: verified, relinked, unknown, by key, alike, inside."""
    ref = table(spark, d, "supplier").selectExpr("concat('K-', s_suppkey, 'A') AS normalized_asset", "concat('TURBINEXPUMP', s_suppkey) AS equipment_tag", "concat('EQ', s_suppkey) AS equipment_id", "s_suppkey AS seq")
    s = "p_partkey % 100"
    tags = table(spark, d, "part").selectExpr("p_partkey", f"CASE p_partkey % 6 WHEN 0 THEN concat('hist!K', {s}, 'A.Flow') WHEN 4 THEN concat('TURBINEYPUMP', {s}) WHEN 5 THEN concat('XTURBINEXPUMP', {s}, '#2') ELSE concat('K', {s}, 'A.x') END AS tag_name", f"CASE p_partkey % 6 WHEN 0 THEN concat('k ', {s}, 'a') WHEN 1 THEN concat('EQ', {s}) WHEN 2 THEN 'ZZ9' ELSE '' END AS equipment_id")
    return ladder.resolved(tags, "p_partkey", ref).select("p_partkey", "normalized_asset", "equipment_id", "asset_match_method", F.round("asset_match_confidence", 6).alias("confidence"))


SERIES_LADDER = """WITH t AS (SELECT p_partkey, p_partkey % 6 AS kind, p_partkey % 100 AS s, (p_partkey % 100) IN (SELECT s_suppkey FROM supplier) AS known FROM part),
x AS (SELECT *, CASE kind WHEN 4 THEN 'TURBINEYPUMP' || s WHEN 5 THEN 'XTURBINEXPUMP' || s ELSE 'K' || s || 'A' END AS key, CASE kind WHEN 0 THEN 'k ' || s || 'a' WHEN 1 THEN 'EQ' || s WHEN 2 THEN 'ZZ9' ELSE '' END AS eq FROM t)
SELECT p_partkey, CASE WHEN known AND kind IN (0, 1, 3) THEN 'K-' || s || 'A' ELSE key END AS normalized_asset, CASE WHEN known AND kind <> 2 THEN 'EQ' || s ELSE eq END AS equipment_id,
 CASE WHEN known AND kind <> 2 THEN ['source_relinked_to_pid', 'source_verified_against_pid', '', 'pid_match_key', 'pid_fuzzy', 'pid_contains'][kind + 1] WHEN eq <> '' THEN 'source_only_no_pid_match' ELSE 'tag_pattern_no_pid_match' END AS asset_match_method,
 CASE WHEN known AND kind IN (0, 1, 3) THEN 1.0 WHEN known AND kind = 4 THEN round((11 + length(s::VARCHAR)) / (12 + length(s::VARCHAR)), 6) WHEN known AND kind = 5 THEN 0.92 ELSE 0.4 END::DOUBLE AS confidence FROM x"""


def header_tables(spark, d):
    """Headers of brands: the sizes of their parts against the numbers of nations, some of them required."""
    present = table(spark, d, "part").selectExpr("p_brand AS dataset", "concat('c', p_size) AS column")
    declared = table(spark, d, "part").select(F.col("p_brand").alias("dataset")).distinct().where("dataset <> 'Brand#1'").join(table(spark, d, "nation").selectExpr("concat('c', n_nationkey) AS column", "n_regionkey = 1 AS required"))
    return gates.header_tables(present, declared)


HEADER_TABLES = """WITH p AS (SELECT DISTINCT p_brand AS d, 'c' || p_size AS c FROM part), w AS (SELECT DISTINCT p_brand AS d, 'c' || n_nationkey AS c, n_regionkey = 1 AS r FROM part, nation WHERE p_brand <> 'Brand#1'),
b AS (SELECT coalesce(p.d, w.d) AS d, coalesce(p.c, w.c) AS c, w.r, p.c IS NOT NULL AS here FROM p FULL JOIN w ON p.d = w.d AND p.c = w.c),
g AS (SELECT d, count(r) AS declared, count(r) FILTER (here) AS present, coalesce(string_agg(c, ',' ORDER BY c) FILTER (r IS NOT NULL AND NOT here), '') AS missing, coalesce(string_agg(c, ',' ORDER BY c) FILTER (r IS NULL AND here), '') AS extra, count(*) FILTER (r AND NOT here) AS blocks FROM b GROUP BY 1)
SELECT d AS dataset, declared, present, round(present / declared * 100, 2) AS coverage_pct, missing, extra, CASE WHEN blocks > 0 THEN 'BLOCK' WHEN missing <> '' THEN 'WARN' ELSE 'PASS' END AS status FROM g WHERE declared > 0"""


def orphan_lines(spark, d):
    """Lines whose part is not among the large ones."""
    return joins.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, d, "part").where("p_size > 10"), "l_partkey", "p_partkey")


def set_difference_some(spark, d):
    """Sizes of parts that are no nation's number, and the other way round."""
    sizes, nations = table(spark, d, "part").selectExpr("p_size AS k"), table(spark, d, "nation").selectExpr("n_nationkey + 10 AS k")
    return sizes.subtract(nations).withColumn("only", F.lit("part")).union(nations.subtract(sizes).withColumn("only", F.lit("nation")))


QUERIES = {
    "work_order_star": (work_order_star, WORK_ORDER_STAR),
    "material_totals": (material_totals, MATERIAL_TOTALS),
    "config_layers": (config_layers, CONFIG_LAYERS),
    "all_relationships": (all_relationships, ALL_RELATIONSHIPS),
    "foreign_keys": (foreign_keys, FOREIGN_KEYS),
    "series_ladder": (series_ladder, SERIES_LADDER),
    "header_tables": (header_tables, HEADER_TABLES),
    "orphan_lines": (orphan_lines, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)"),
    "set_difference_some": (set_difference_some, "SELECT k, 'part' AS only FROM (SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey + 10 FROM nation) UNION ALL SELECT k, 'nation' FROM (SELECT n_nationkey + 10 AS k FROM nation EXCEPT SELECT p_size FROM part)"),
}
