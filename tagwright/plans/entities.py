"""Queries on entities and on writing them: templates, standard fields, upserts, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.operators import entities as e
from tagwright.operators import joins, merge
from tagwright.plans.series import table


def entity_builder(spark, d):
    s = table(spark, d, "supplier").select(F.expr("CASE WHEN s_suppkey % 7 = 0 THEN '  ' ELSE concat(' ', s_name) END").alias("EQUNR"), F.col("s_acctbal").cast("string").alias("cost"), F.lit("x").alias("plant_code_id"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 0.5 END").alias("conf"), F.col("s_nationkey").alias("nation"))
    schema = {"equipment_uid": "string", "equipment_id": "string", "cost": "decimal(18,2)", "maker": "string", "plant_code_id": "string", "confidence": "double", "is_active": "int"}
    attributes = {"equipment_id": ["sap_equi.NO_SUCH", "sap_equi.EQUNR"], "cost": ["other.cost", "sap_equi.cost"], "maker": ["sap_equi.HERST"], "confidence": ["sap_equi.conf"]}
    return e.build({"sap_equi": s.union(s)}, schema, attributes, ["plant_code_id", "equipment_id"], "equipment_uid", "eqp", "p1", extras=["nation"])


ENTITY_BUILDER = """SELECT DISTINCT 'eqp:' || sha1('p1|' || trim(s_name)) AS equipment_uid, trim(s_name) AS equipment_id, s_acctbal::DECIMAL(18, 2) AS cost, NULL::VARCHAR AS maker, 'p1' AS plant_code_id, CASE WHEN s_suppkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, 1 AS is_active, s_nationkey AS nation
FROM supplier WHERE s_suppkey % 7 <> 0"""


def derived_fields(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("AUFNR"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN concat('W', o_custkey % 5) END").alias("WERKS"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'B1' END").alias("BUKRS"))
    return e.derived(o, "sap_orders").select("AUFNR", "plant_code_id", "source_system", "source_record_id")


DERIVED = """WITH o AS (SELECT o_orderkey, coalesce(CASE o_orderkey % 3 WHEN 1 THEN concat('W', o_custkey % 5) END, CASE WHEN o_orderkey % 4 = 0 THEN 'B1' END, 'UNKNOWN') AS p FROM orders)
SELECT o_orderkey AS AUFNR, p AS plant_code_id, 'SAP' AS source_system, sha1(p || '|' || o_orderkey) AS source_record_id FROM o"""


def packed_attributes(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("pi_brand"), F.expr("CASE WHEN p_size % 3 > 0 THEN ' ' ELSE p_type END").alias("pi_kind"), F.expr("CASE WHEN p_size % 2 = 0 THEN p_size END").cast("string").alias("sap_size"))
    out = e.packed(p, ["sap_", "pi_", "none_"])
    return out.select("p_partkey", F.get_json_object("source_attributes", "$.pi.brand").alias("brand"), F.get_json_object("source_attributes", "$.pi.kind").alias("kind"), F.get_json_object("source_attributes", "$.sap.size").alias("size"), F.array_join(F.json_object_keys("source_attributes"), ",").alias("sources"))


PACKED = "SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN trim(p_type) END AS kind, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS size, CASE WHEN p_size % 2 = 0 THEN 'pi,sap' ELSE 'pi' END AS sources FROM part"


def readable_names(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c-"), F.col("o_custkey") % 300).alias("equipment_id"), "o_orderstatus")
    names = table(spark, d, "customer").select(F.concat(F.lit("C-"), "c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END").alias("text"))
    return e.readable(o, "equipment_id", names, "id", "text", "equipment")


READABLE = """WITH n AS (SELECT c_custkey, c_mktsegment[1] || lower(c_mktsegment[2:]) AS t FROM customer WHERE c_custkey % 3 <> 0)
SELECT o_orderkey, 'c-' || o_custkey % 300 AS equipment_id, coalesce(t || ' (c-' || o_custkey % 300 || ')', 'c-' || o_custkey % 300) AS equipment, o_orderstatus FROM orders LEFT JOIN n ON c_custkey = o_custkey % 300"""


def ontology_uids(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('uid-', p_size) WHEN 1 THEN cast(p_size AS STRING) ELSE ' ' END").alias("u"), F.expr("CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_brand END").alias("site"))
    return e.with_plant(p.withColumn("ontology_uid", e.ontology_uid("u")), "p9").drop("u")


ONTOLOGY = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'uid-' || p_size END AS ontology_uid, 'p9' AS plant_code_id, CASE WHEN p_size % 2 = 0 THEN '-' ELSE p_brand END AS site FROM part"


def tag_metadata(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN concat('d', l_orderkey) END").alias("description"), F.expr("CASE WHEN l_quantity > 20 THEN concat('u', l_orderkey) ELSE ' ' END").alias("uom"), F.col("l_discount").alias("low"), F.col("l_tax").alias("high"), F.col("l_quantity").alias("confidence"), F.col("l_returnflag").alias("source"))
    return e.tag_metadata(li, "l_partkey", "seq", "description", "uom", "low", "high", "confidence", "source")


TAG_METADATA = """SELECT l_partkey, arg_min('d' || l_orderkey, l_orderkey * 10 + l_linenumber) FILTER (l_linenumber % 2 = 0) AS description, arg_min('u' || l_orderkey, l_orderkey * 10 + l_linenumber) FILTER (l_quantity > 20) AS uom,
 min(l_discount) AS low, max(l_tax) AS high, max(l_quantity) AS confidence, array_to_string(list_sort(list_distinct(list(l_returnflag))), ' | ') AS source FROM lineitem GROUP BY 1"""

BATCH = "SELECT o_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price FROM orders WHERE o_custkey % 3 <> 0"
STORED = "SELECT c_custkey AS k, c_mktsegment AS status, c_acctbal AS price FROM customer WHERE c_custkey % 2 = 0"


def batch(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 3 <> 0").selectExpr("o_custkey AS k", "o_orderkey AS seq", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price")
    return o, table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "c_mktsegment AS status", "c_acctbal AS price")


def insert_deduped(spark, d):
    return merge.insert_deduped(*batch(spark, d), ["k"], "seq").drop("outcome")


INSERT_DEDUPED = f"""WITH n AS ({BATCH}), s AS ({STORED}), o AS (SELECT k, arg_max(status, seq) AS status, arg_max(price, seq) AS price FROM n GROUP BY k)
SELECT k, coalesce(o.status, s.status) AS status, coalesce(o.price, s.price) AS price FROM o FULL JOIN s USING (k)"""


def bulk_upsert(spark, d):
    return merge.bulk_upsert(*batch(spark, d), ["k"], "seq")


BULK_UPSERT = f"""WITH n AS ({BATCH}), s AS ({STORED}) SELECT k, status, price FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1 UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM n)"""


def delete_rows(spark, d):
    asked, old = batch(spark, d)
    kept, missing = merge.delete_rows(old, asked, ["k"])
    return kept.select("k", F.lit("kept").alias("outcome")).union(missing.select("k", F.lit("not_found").alias("outcome")))


DELETE_ROWS = f"WITH n AS ({BATCH}), s AS ({STORED}) SELECT k, 'kept' AS outcome FROM s WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT DISTINCT k, 'not_found' FROM n WHERE k NOT IN (SELECT k FROM s)"


def strict_replace(spark, d):
    new, old = batch(spark, d)
    return merge.replace_strictly(new.groupBy("k").agg(F.max("status").alias("status"), F.max("price").alias("price")), old, "k")


STRICT_REPLACE = f"WITH n AS ({BATCH}), s AS ({STORED}) SELECT k, max(status) AS status, max(price) AS price FROM n GROUP BY k UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM n)"


def document_upsert(spark, d):
    p = table(spark, d, "part")
    old = p.where("p_partkey % 5 > 0").selectExpr("p_partkey AS record_id", "p_name AS title", "p_size AS pages", "CASE WHEN p_partkey % 4 = 0 THEN 'ann' END AS edited_by", "3 AS row_version")
    new = p.where("p_partkey % 3 > 0").selectExpr("p_partkey AS record_id", "CASE WHEN p_size % 2 = 0 THEN 'new' ELSE p_name END AS title", "p_size AS pages", "CASE WHEN p_partkey % 8 = 0 THEN 'bob' END AS edited_by")
    return merge.document_upsert(new, old, ["record_id"], ["title", "pages"])


DOCUMENT_UPSERT = """WITH p AS (SELECT p_partkey AS k, p_name, p_size, k % 5 > 0 AS o, k % 3 > 0 AS n, k % 4 = 0 AS held, k % 8 = 0 AS person, p_size % 2 = 0 AND p_name <> 'new' AS differs FROM part WHERE k % 5 > 0 OR k % 3 > 0),
r AS (SELECT *, CASE WHEN NOT n THEN 'kept' WHEN NOT o THEN 'inserted' WHEN differs AND (NOT held OR person) THEN 'updated' ELSE 'unchanged' END AS outcome FROM p)
SELECT k AS record_id, CASE WHEN outcome IN ('inserted', 'updated') AND p_size % 2 = 0 THEN 'new' ELSE p_name END AS title, p_size AS pages, CASE WHEN outcome IN ('inserted', 'updated') THEN CASE WHEN person THEN 'bob' END WHEN held THEN 'ann' END AS edited_by,
 CASE outcome WHEN 'inserted' THEN 1 WHEN 'updated' THEN 4 ELSE 3 END AS row_version, outcome FROM r"""


def view_by_label(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderpriority AS label", "o_custkey AS ref", "o_orderkey AS seq")
    return merge.replace_label(o, o.where("seq % 2 = 0").select("label", "ref", "seq"), "label", "2-HIGH", ["ref"], "seq")


VIEW_BY_LABEL = "SELECT o_orderpriority AS label, o_custkey AS ref, o_orderkey AS seq FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '2-HIGH' UNION ALL SELECT '2-HIGH', o_custkey, max(o_orderkey) FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 2"


def duplicate_verdicts(spark, d):
    files = lambda where, uid: table(spark, d, "documents").where(where).select(F.concat(F.lit("f"), "doc_id").alias(uid), F.concat("source", F.lit("-"), F.col("doc_id") % 40).alias("file_name"), F.col("n_chars").alias("size_bytes"), F.md5("text").alias("content_hash"), F.expr("CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END").alias("category"), F.col("doc_id").alias("seq"))
    return merge.duplicate_verdicts(files("doc_id % 2 = 1", "file_uid"), files("doc_id % 2 = 0", "flow_uid"), "seq")


DUPLICATES = """WITH f AS (SELECT doc_id AS seq, 'f' || doc_id AS uid, source || '-' || doc_id % 40 AS name, n_chars AS size, md5(text) AS hash, lang AS category FROM documents),
h AS (SELECT a.uid, arg_min({'of': b.uid, 'r': CASE WHEN a.hash = b.hash AND a.category = b.category THEN 1 WHEN a.hash = b.hash THEN 2 WHEN a.size = b.size THEN 3 ELSE 4 END}, (CASE WHEN a.hash = b.hash AND a.category = b.category THEN 1 WHEN a.hash = b.hash THEN 2 WHEN a.size = b.size THEN 3 ELSE 4 END, b.seq)) AS x
 FROM f a JOIN f b ON (a.hash = b.hash OR a.name = b.name) AND a.seq % 2 = 1 AND b.seq % 2 = 0 GROUP BY a.uid)
SELECT f.uid AS file_uid, x.of AS duplicate_of, ['content_hash', 'content_hash_other_category', 'name_and_size', 'name_only'][x.r] AS matched_on, coalesce(x.r < 4, FALSE) AS is_duplicate FROM f LEFT JOIN h USING (uid) WHERE f.seq % 2 = 1"""


def index_to_tag(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("tag"))
    c = table(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE cast(c_custkey % 40 AS STRING) END").alias("ref"))
    return joins.index_to_tag(c, "ref", n, "place", "tag")


INDEX_TO_TAG = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE coalesce(n_name, (c_custkey % 40)::VARCHAR) END AS ref FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40"

QUERIES = {
    "entity_builder": (entity_builder, ENTITY_BUILDER),
    "derived_fields": (derived_fields, DERIVED),
    "packed_attributes": (packed_attributes, PACKED),
    "readable_names": (readable_names, READABLE),
    "ontology_uids": (ontology_uids, ONTOLOGY),
    "tag_metadata": (tag_metadata, TAG_METADATA),
    "insert_deduped": (insert_deduped, INSERT_DEDUPED),
    "bulk_upsert": (bulk_upsert, BULK_UPSERT),
    "delete_rows": (delete_rows, DELETE_ROWS),
    "strict_replace": (strict_replace, STRICT_REPLACE),
    "document_upsert": (document_upsert, DOCUMENT_UPSERT),
    "view_by_label": (view_by_label, VIEW_BY_LABEL),
    "duplicate_verdicts": (duplicate_verdicts, DUPLICATES),
    "index_to_tag": (index_to_tag, INDEX_TO_TAG),
}
