"""Queries on columns, first rows, maps, files and identities that the other plans leave out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagwright.functions import coerce
from tagwright.functions import text as x
from tagwright.operators import gates, graph, joins, merge
from tagwright.operators import identity as ident
from tagwright.operators import tables as t
from tagwright.plans.series import table
from tagwright.sources import tables as files
from tagwright.sources.shared import shared_folder
from tagwright.streaming import live


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def renamed_columns(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("Part Key"), F.col("p_name").alias("PART-NAME"), F.col("p_brand").alias("Brand."), F.col("p_size").alias("sizeA"), F.col("p_type").alias("size_b"))
    return t.rename(p, {"partkey": "id", "part_name": "name", "SIZE A": "size", "size b": "size"}, {"size": ["size b", "size a"]})


def conformed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE cast(o_custkey AS STRING) END").alias("customer"), F.col("o_orderstatus").alias("extra"))
    return t.conform(o, {"customer": "int", "note": "string", "o_orderkey": "bigint"}, keep_extra=True)


def snake_columns(spark, d):
    n = table(spark, d, "nation")
    return t.normalize_columns(n.select(F.col("n_nationkey").alias("Nation Key"), F.col("n_name").alias("nation-key"), F.col("n_regionkey").alias("##")))


def first_rows(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return t.keep_first(o, ["o_custkey"], ["o_orderkey"])


def guarded_upsert(spark, d):
    p = table(spark, d, "part")
    old = p.where("p_partkey % 4 > 0").selectExpr("p_partkey AS k", "p_name AS name", "CASE WHEN p_partkey % 3 = 0 THEN 'ann' END AS edited_by")
    new = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS k", "'new' AS name", "cast(NULL AS STRING) AS edited_by")
    return merge.guarded_upsert(new, old, ["k"]).drop("outcome")


GUARDED = """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 AND NOT (p_partkey % 4 > 0 AND p_partkey % 3 = 0) THEN 'new' ELSE p_name END AS name, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 3 = 0 THEN 'ann' END AS edited_by FROM part WHERE p_partkey % 4 > 0 OR p_partkey % 2 = 0"""


def merged_properties(spark, d):
    p = table(spark, d, "part")
    m = lambda *kv: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in kv])
    old = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("k"), m("a", F.col("p_brand"), "b", "old").alias("properties"), m("a", F.expr("CASE WHEN p_size % 2 = 0 THEN 'ui_update' ELSE 'sap' END")).alias("lineage"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), m("a", "new", "c", F.col("p_type")).alias("properties"), m("a", "pid").alias("lineage"))
    out = merge.merge_properties(new, old, "k")
    return out.select("k", *[F.try_element_at("properties", F.lit(c)).alias(c) for c in "abc"], F.try_element_at("lineage", F.lit("a")).alias("lineage_a"))


MERGED_PROPERTIES = """WITH p AS (SELECT *, p_partkey % 3 > 0 AS o, p_partkey % 2 = 0 AS n, p_partkey % 3 > 0 AND p_size % 2 = 0 AS held FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0)
SELECT p_partkey AS k, CASE WHEN n AND NOT held THEN 'new' ELSE p_brand END AS a, CASE WHEN o THEN 'old' END AS b, CASE WHEN n THEN p_type END AS c, CASE WHEN held THEN 'ui_update' WHEN n THEN 'pid' ELSE 'sap' END AS lineage_a FROM p"""


def cleaned_values(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("concat('in\\\\\\\\x/', p_brand, '.csv')").alias("path"), F.expr("CASE p_size % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE p_size * 1.5D END").alias("v"), F.expr("concat('token = ', p_brand, ' and API-Key:x9 ok')").alias("message"))
    return p.select("p_partkey", x.basename("path").alias("file"), coerce.finite("v").alias("v"), x.redact("message").alias("message"))


CLEANED = "SELECT p_partkey, p_brand || '.csv' AS file, CASE WHEN p_size % 4 > 1 THEN p_size * 1.5 END::DOUBLE AS v, 'token = *** and API-Key:*** ok' AS message FROM part"


def many_formats(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 3 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE 'soon' END").alias("t"))
    return o.select("o_orderkey", F.unix_millis(coerce.timestamp("t")).alias("ms"))


def mapped_values(spark, d):
    m = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("old"), F.col("n_name").alias("new"))
    return joins.with_mapped(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation")), "nation", m)


def source_file_filter(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("concat('a/b\\\\\\\\', p_brand, '.xlsx')").alias("source_file"))
    return p.where(x.basename("source_file") == "Brand#11.xlsx").select("p_partkey")


def first_columns_search(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return t.search(p, "brand#1", 2).union(t.search(p, "BRAND#11", 3)).select("p_partkey")


def unique_key_gate(spark, d):
    li = table(spark, d, "lineitem").select(F.expr("CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_orderkey END").alias("k"), "l_linenumber")
    return gates.natural_key(li, ["k", "l_linenumber"], 0.1)


def property_keys(spark, d):
    n = table(spark, d, "part").select(F.col("p_brand").alias("label"), F.expr("CASE WHEN p_size % 2 = 0 THEN '{\"a\":1,\"b\":2}' ELSE '{\"c\":3}' END").alias("properties"))
    return graph.property_keys(n, "properties")


def csv_round_trip(spark, d):
    """A table written as CSV, found again by its name in a folder below, and read as text."""
    folder = scratch(spark, "csv")
    p = table(spark, d, "part").select(F.col("p_partkey").alias(" p_partkey "), F.expr("CASE WHEN p_size % 3 > 0 THEN p_name END").alias("p_name"))
    p.write.option("header", True).csv(f"{folder}/deep/down/part_export.csv")
    return files.read(spark, files.resolve(spark, folder, "part"))


def parquet_round_trip(spark, d):
    folder = scratch(spark, "parquet")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(f"{folder}/orders.parquet")
    return files.read(spark, files.resolve(spark, folder, "orders"))


def replace_by_scope(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.col("doc_id").alias("created"))
    new = docs.where("lang = 'en' and doc_id % 7 = 0").withColumns({"doc_id": F.col("doc_id") + 1_000_000, "created": F.lit(10**9).cast("long")})
    return merge.replace_by_file(new, docs, "source", "created", ["lang"])


REPLACE_BY_SCOPE = """WITH n AS (SELECT doc_id + 1000000 AS doc_id, source, lang FROM documents WHERE lang = 'en' AND doc_id % 7 = 0), f AS (SELECT source, min(doc_id) AS created FROM documents GROUP BY 1)
SELECT doc_id, source, lang, doc_id AS created FROM documents d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = d.source AND n.lang = d.lang) UNION ALL SELECT n.doc_id, source, lang, created FROM n JOIN f USING (source)"""


def measurement_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('a.', p_partkey) WHEN 1 THEN concat('a_', p_partkey - 1) WHEN 2 THEN '%%' ELSE concat('m', p_partkey) END").alias("raw"))
    return t.unique_measurements(p, "raw").select("p_partkey", "measurement")


MEASUREMENTS = """WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a.' || p_partkey WHEN 1 THEN 'a_' || p_partkey - 1 WHEN 2 THEN '%%' ELSE 'm' || p_partkey END AS raw FROM part),
q AS (SELECT *, regexp_replace(regexp_replace(raw, '[.\\s/-]', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS norm FROM p), r AS (SELECT *, CASE WHEN norm = raw THEN norm WHEN norm = '' THEN 'm_' || sha1(raw)[1:4] ELSE norm || '_' || sha1(raw)[1:4] END AS sure, CASE WHEN norm = '' THEN 'm_' || sha1(raw)[1:4] ELSE norm END AS plain FROM q)
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY plain) > 1 THEN sure ELSE plain END AS measurement FROM r"""


def connector_states(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey AS flow", "CASE o_orderkey % 5 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing' WHEN 2 THEN 'processed' WHEN 3 THEN 'committed' ELSE 'superseded' END AS stage", "CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'skipped' ELSE 'ok' END AS status", "o_orderkey AS at")
    states = {"uploaded": ("uploaded", 1), "processing": ("processing", 2), "processed": ("processed", 3), "committed": ("committed", 5)}
    return gates.connector_states(o, ["flow"], states, ["processed", "committed"], ["uploaded", "processing"], "at")


STATES = """WITH o AS (SELECT o_custkey AS flow, o_orderkey AS k, CASE WHEN k % 7 = 0 THEN 'failed' WHEN k % 11 = 0 THEN 'skipped' WHEN k % 5 = 4 THEN 'superseded' WHEN k % 5 = 1 THEN 'processing' WHEN k % 5 IN (2, 3) THEN 'processed' ELSE 'pending' END AS b, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 5 ELSE 0 END AS r FROM orders),
g AS (SELECT flow, count(*) AS files_total, count(*) FILTER (b = 'pending') AS pending, count(*) FILTER (b = 'processing') AS processing, count(*) FILTER (b = 'processed') AS processed, count(*) FILTER (b = 'failed') AS failed, count(*) FILTER (b = 'skipped') AS skipped, count(*) FILTER (b = 'superseded') AS superseded, count(*) FILTER (k % 5 < 2) AS unprocessed, min(k) AS earliest, max(k) AS latest, max(r) AS r FROM o GROUP BY 1)
SELECT flow, files_total, pending, processing, processed, failed, skipped, superseded, unprocessed, earliest, latest, CASE WHEN unprocessed > 0 AND r > 1 THEN 'uploaded' ELSE CASE r WHEN 0 THEN 'not_configured' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'processing' WHEN 3 THEN 'processed' ELSE 'committed' END END AS status FROM g"""


def document_identity(spark, d):
    docs = table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN concat(100 + o_custkey % 900, 'KG') WHEN 1 THEN 'B12-K-0001' WHEN 2 THEN '' ELSE ' ' END AS equipment_tag", "CASE o_orderkey % 5 WHEN 2 THEN 'the Rotary Kiln drive' WHEN 3 THEN concat('pump ', o_custkey) ELSE '' END AS label")
    return ident.documents(docs, "equipment_tag", "label").select("o_orderkey", "normalized_asset", "asset_match_method", "asset_match_confidence")


DOCUMENT_IDENTITY = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 100 + o_custkey % 900 || 'KG' WHEN 1 THEN 'B12-K-0001' WHEN 2 THEN 'CP-KN-0001' WHEN 3 THEN 'pump ' || o_custkey ELSE '' END AS normalized_asset,
 CASE o_orderkey % 5 WHEN 0 THEN 'inline_tag' WHEN 1 THEN 'inline_tag' WHEN 2 THEN 'name_map' WHEN 3 THEN 'name_fallback' ELSE 'none' END AS asset_match_method, CASE o_orderkey % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS asset_match_confidence FROM orders"""


def series_identity(spark, d):
    asked = table(spark, d, "part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN concat('KG', p_partkey) WHEN 1 THEN concat('351KG', p_partkey, 'A') WHEN 2 THEN concat('zz', p_partkey * 7 + 100000) ELSE 'a' END AS key")
    known = table(spark, d, "part").where("p_partkey % 3 > 0").selectExpr("concat(CASE WHEN p_partkey % 4 = 1 THEN '351XKG' ELSE 'KG' END, p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'A' ELSE '' END) AS key", "concat('asset ', p_partkey) AS asset", "p_partkey AS seq")
    more = table(spark, d, "part").where("p_partkey % 4 = 1").selectExpr("concat('U351KG', p_partkey, 'A') AS key", "concat('unit ', p_partkey) AS asset", "p_partkey + 1000000 AS seq")
    return ident.series(asked, "p_partkey", "key", known.union(more))


SERIES_IDENTITY = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 > 0 THEN 'asset ' || p_partkey WHEN p_partkey % 4 = 1 THEN 'unit ' || p_partkey ELSE '' END AS asset,
 CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 > 0 THEN 'exact' WHEN p_partkey % 4 = 1 THEN 'contains' WHEN p_partkey % 4 = 3 THEN 'key_too_short' ELSE 'none' END AS method,
 CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 > 0 THEN 1.0 WHEN p_partkey % 4 = 1 THEN 0.92 ELSE 0.0 END::DOUBLE AS confidence FROM part"""


def model_graph(spark, d):
    s = {n: table(spark, d, n) for n in ("region", "nation", "supplier")}
    nodes, rels = graph.build(s, {"region": ("r_regionkey", "Area", "r_name"), "nation": ("n_nationkey", "Plant", "n_name"), "supplier": ("s_suppkey", "Equipment", "s_name")}, [("nation", "n_regionkey", "region", "PART_OF"), ("supplier", "s_nationkey", "nation", "LOCATED_AT")])
    return nodes.select(F.col("node_id").alias("a"), F.col("label").alias("b"), F.col("name").alias("c")).union(rels.select("from_node_id", "rel_type", "to_node_id"))


MODEL_GRAPH = """SELECT r_regionkey || '#region' AS a, 'Area' AS b, r_name AS c FROM region UNION ALL SELECT n_nationkey || '#nation', 'Plant', n_name FROM nation UNION ALL SELECT s_suppkey || '#supplier', 'Equipment', s_name FROM supplier
UNION ALL SELECT n_nationkey || '#nation', 'PART_OF', n_regionkey || '#region' FROM nation UNION ALL SELECT s_suppkey || '#supplier', 'LOCATED_AT', s_nationkey || '#nation' FROM supplier"""


def log_sink(spark, d):
    """API log records as a stream to folders of days, read back."""
    folder = scratch(spark, "log")
    table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").repartition(2).write.parquet(f"{folder}/in")
    stream = live.samples(spark, f"{folder}/in", "event_id long, ts timestamp, event_type string")
    live.log_batches(stream, f"{folder}/out", f"{folder}/checkpoint", every=None).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


QUERIES = {
    "renamed_columns": (renamed_columns, 'SELECT p_partkey AS id, p_name AS name, p_brand AS "Brand.", p_size AS sizeA, p_type AS size FROM part'),
    "conformed": (conformed, "SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS customer, NULL AS note, o_orderkey, o_orderstatus AS extra FROM orders"),
    "snake_columns": (snake_columns, "SELECT n_nationkey AS nation_key, n_name AS nation_key_2, n_regionkey AS column_3 FROM nation"),
    "first_rows": (first_rows, "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"),
    "guarded_upsert": (guarded_upsert, GUARDED),
    "merged_properties": (merged_properties, MERGED_PROPERTIES),
    "cleaned_values": (cleaned_values, CLEANED),
    "many_formats": (many_formats, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN epoch_ms(CASE WHEN o_orderkey % 5 = 0 THEN date_trunc('second', o_orderdate::TIMESTAMP) ELSE o_orderdate::DATE::TIMESTAMP END) END AS ms FROM orders"),
    "mapped_values": (mapped_values, "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN n_name ELSE c_nationkey::VARCHAR END AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "source_file_filter": (source_file_filter, "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'"),
    "first_columns_search": (first_columns_search, "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT p_partkey FROM part WHERE contains(lower(p_name || '|' || p_type), 'brand#1')"),
    "unique_key_gate": (unique_key_gate, "WITH g AS (SELECT CASE WHEN l_orderkey % 5 > 0 THEN l_orderkey END AS k, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (k IS NULL), 0)::BIGINT AS null_keys, coalesce(sum(n) FILTER (k IS NOT NULL AND n > 1), 0)::BIGINT AS duplicate_rows FROM g) SELECT *, CASE WHEN null_keys / n_rows > 0.1 THEN 'BLOCK' WHEN duplicate_rows > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM s"),
    "property_keys": (property_keys, "SELECT DISTINCT p_brand AS label, unnest(CASE WHEN p_size % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END) AS key FROM part"),
    "csv_round_trip": (csv_round_trip, "SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name ELSE '' END AS p_name FROM part"),
    "parquet_round_trip": (parquet_round_trip, "SELECT o_orderkey, o_orderstatus FROM orders"),
    "replace_by_scope": (replace_by_scope, REPLACE_BY_SCOPE),
    "measurement_names": (measurement_names, MEASUREMENTS),
    "connector_states": (connector_states, STATES),
    "document_identity": (document_identity, DOCUMENT_IDENTITY),
    "series_identity": (series_identity, SERIES_IDENTITY),
    "model_graph": (model_graph, MODEL_GRAPH),
    "log_sink": (log_sink, "SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1"),
}
