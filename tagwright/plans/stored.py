"""Queries on stored tables: uploads, consolidation, gates, rollups, pages, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.functions import coerce
from tagwright.functions import text as x
from tagwright.operators import gates, merge
from tagwright.operators import tables as t
from tagwright.plans.series import table
from tagwright.sources.tables import log_lines


def uploads(spark, d):
    """A stored table of orders and a later upload: every third order comes again with a blank or a new status."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("X"), "o_totalprice": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") + 1)})
    return new, o.where("o_orderkey % 4 <> 1")


def merge_on_write(spark, d):
    new, old = uploads(spark, d)
    return merge.merge_on_write(new, old, ["o_orderkey"], "o_totalprice")


def coalesce_upsert(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_suppkey % 2 = 0").withColumns({"s_name": F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")), "s_acctbal": F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(F.col("s_acctbal"))})
    return merge.coalesce_upsert(new, s.where("s_suppkey % 5 <> 0"), ["s_suppkey"])


def replace_by_file(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.col("doc_id").alias("created"))
    new = docs.where("lang = 'en' and doc_id % 7 = 0").withColumns({"doc_id": F.col("doc_id") + 1_000_000, "created": F.lit(10**9).cast("long")})
    return merge.replace_by_file(new, docs, "source", "created")


def version_conflicts(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("row_version"))
    return merge.version_conflicts(p.withColumn("row_version", F.when(F.col("p_partkey") % 9 == 0, 0).otherwise(F.col("row_version"))), p, ["p_partkey"])


def source_priority_merge(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("nation"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("name"), F.lit(None).cast("string").alias("segment"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return t.consolidate([s, c], ["nation"])


def occurrence_suffix(spark, d):
    return t.suffixed(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name")), "name", ["p_partkey"])


def bom_positions(spark, d):
    n = t.numbered(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber", "l_partkey"])
    return n.withColumn("position", F.lpad((F.col("occurrence") * 10).cast("string"), 4, "0")).drop("occurrence")


def stable_keys(spark, d):
    return t.stable_keys(table(spark, d, "part").select("p_partkey", "p_name"), "p_name").groupBy("p_name").agg(F.count("*").alias("n_rows"), F.count_distinct("stable_key").alias("n_keys"))


def natural_key_check(spark, d):
    return gates.natural_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def dq_basics(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    return gates.basics(c)


def type_conformance(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_totalprice").cast("string").alias("b"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("c"))
    return gates.type_conformance(o, {"a": "numeric", "b": "numeric", "c": "date"})


def referential_integrity(spark, d):
    return gates.references(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size > 10"), "p_partkey")


def row_drift(spark, d):
    n = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    before = table(spark, d, "documents").where("lang = 'en'").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return gates.drift(n, before)


def gate_rollup(spark, d):
    p = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") > 48, "BLOCK").when(F.col("p_size") > 40, "WARN").otherwise("PASS").alias("s"))
    return p.groupBy("p_brand").agg(gates.worst(F.col("s")).alias("status"))


def status_rollup(spark, d):
    bucket = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "pending").otherwise("other")
    return table(spark, d, "orders").groupBy("o_custkey").agg(*[F.count_if(bucket == b).alias(b) for b in ("committed", "pending", "other")], F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"))


def group_rollup(spark, d):
    return t.rollup(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


def table_search_page(spark, d):
    return t.page(t.search(table(spark, d, "part"), "Widget"), ["p_partkey"], 20, 5)


def chunk_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(x.chunks("text", 1000, 100)).alias("chunk", "piece")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("digest"))


def parse_log_lines(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 ["), F.when(F.col("value") > 90, "ERROR").otherwise("INFO"), F.lit("] "), "event_type").alias("value"))
    return log_lines(e.withColumn("value", F.when(F.col("event_id") % 11 == 0, "no log line").otherwise(F.col("value")))).drop("value")


def log_facets(spark, d):
    lines = table(spark, d, "events").select(F.when(F.col("value") > 90, "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("source"))
    return lines.groupingSets([["level"], ["source"]], "level", "source").agg(F.count("*").alias("n"))


def doc_ledger_resume(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("fingerprint"))
    done = docs.where("doc_id % 3 = 0").withColumn("fingerprint", F.when(F.col("doc_id") % 2 == 0, F.col("fingerprint")).otherwise("stale"))
    return docs.join(done, ["doc_id", "fingerprint"], "left_anti")


def integrated_view(spark, d):
    first = t.keep_first(table(spark, d, "labels").where("quality is not null"), ["doc_id"], ["quality"])
    return table(spark, d, "documents").select("doc_id", "source", "lang").join(first, "doc_id", "left").select("doc_id", "source", "lang", F.coalesce(F.col("quality"), F.lit(-1)).alias("quality"))


LIMIT = "CASE p_partkey % 8 WHEN 0 THEN concat(p_size, 'k') WHEN 1 THEN '-' WHEN 2 THEN p_name WHEN 3 THEN concat('1,', 100 + p_size) WHEN 4 THEN concat(p_size, '.5 degC') WHEN 5 THEN ' ' WHEN 6 THEN concat('-', p_size, 'e2') ELSE 'Faulty tag' END"


def numeric_limits(spark, d):
    return table(spark, d, "part").select("p_partkey", coerce.numeric_limit(F.expr(LIMIT)).alias("v")).select("p_partkey", "v.value", "v.reason")


def coerce_values(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", coerce.first_number("o_orderpriority").alias("priority"), coerce.truth(F.when(F.col("o_orderstatus") == "O", "Yes").otherwise("0")).alias("is_open"), coerce.epoch_ms(F.col("o_orderkey")).alias("ms"))


def distinct_values(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").select("s_nationkey"))


QUERIES = {
    "merge_on_write": (
        merge_on_write,
        "WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'X' END AS o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice + 1 END AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0), o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 4 <> 1) SELECT n.o_orderkey, CASE WHEN trim(n.o_orderstatus) = '' THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, coalesce(n.o_orderpriority, o.o_orderpriority) AS o_orderpriority, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM n LEFT JOIN o USING (o_orderkey) UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)",
    ),
    "coalesce_upsert": (
        coalesce_upsert,
        "WITH s AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier), o AS (FROM s WHERE s_suppkey % 5 <> 0), n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM s WHERE s_suppkey % 2 = 0), b AS (SELECT coalesce(n.s_suppkey, o.s_suppkey) AS s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal, n.s_suppkey AS nk, o.s_suppkey AS ok, o.s_name AS oname, o.s_acctbal AS obal FROM n FULL JOIN o ON n.s_suppkey = o.s_suppkey) SELECT s_suppkey, s_name, s_acctbal, CASE WHEN nk IS NULL THEN 'kept' WHEN ok IS NULL THEN 'inserted' WHEN s_name IS NOT DISTINCT FROM oname AND s_acctbal IS NOT DISTINCT FROM obal THEN 'unchanged' ELSE 'updated' END AS outcome FROM b",
    ),
    "replace_by_file": (
        replace_by_file,
        "WITH o AS (SELECT doc_id, source, lang, doc_id AS created FROM documents), n AS (SELECT doc_id + 1000000 AS doc_id, source, lang FROM o WHERE lang = 'en' AND doc_id % 7 = 0) SELECT * FROM o WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT n.*, (SELECT min(created) FROM o WHERE o.source = n.source) FROM n",
    ),
    "version_conflicts": (version_conflicts, "SELECT p_partkey, 0 AS row_version, p_size AS stored_version FROM part WHERE p_partkey % 9 = 0 AND p_size <> 0"),
    "source_priority_merge": (
        source_priority_merge,
        "WITH a AS (SELECT 0 AS p, s_nationkey::VARCHAR AS nation, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, NULL AS segment FROM supplier UNION ALL SELECT 1, c_nationkey::VARCHAR, c_name, c_mktsegment FROM customer) SELECT nation, arg_min(name, (p, name)) FILTER (WHERE name IS NOT NULL) AS name, min(segment) AS segment FROM a GROUP BY 1",
    ),
    "occurrence_suffix": (occurrence_suffix, "SELECT p_partkey, CASE WHEN n > 1 THEN p_brand || '#' || n ELSE p_brand END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)"),
    "bom_positions": (bom_positions, "SELECT l_orderkey, l_partkey, l_linenumber, lpad((10 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey))::VARCHAR, 4, '0') AS position FROM lineitem"),
    "stable_keys": (stable_keys, "SELECT p_name, count(*) AS n_rows, count(*) AS n_keys FROM part GROUP BY 1"),
    "natural_key_check": (natural_key_check, "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT sum(n)::BIGINT AS n_rows, 0::BIGINT AS null_keys, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicate_rows, CASE WHEN max(n) > 1 THEN 'WARN' ELSE 'PASS' END AS status FROM g"),
    "dq_basics": (
        dq_basics,
        "WITH g AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_custkey % 10 = 0) AS names, count(*) FILTER (WHERE c_acctbal < 0) AS balances FROM customer) SELECT 'c_custkey' AS \"column\", 0::BIGINT AS missing, n_rows, 0.0::DOUBLE AS missing_pct FROM g UNION ALL SELECT 'c_name', names, n_rows, round(names / n_rows * 100, 2) FROM g UNION ALL SELECT 'c_acctbal', balances, n_rows, round(balances / n_rows * 100, 2) FROM g",
    ),
    "type_conformance": (type_conformance, "SELECT 'a' AS \"column\", count(*) AS filled, count(*) AS bad, 100.0::DOUBLE AS bad_pct FROM orders UNION ALL SELECT unnest(['b', 'c']), count(*), 0, 0.0 FROM orders"),
    "referential_integrity": (referential_integrity, "WITH g AS (SELECT count(*) AS referring, count(*) FILTER (WHERE p_partkey IS NULL) AS unresolved FROM lineitem LEFT JOIN (FROM part WHERE p_size > 10) ON p_partkey = l_partkey) SELECT *, round(unresolved / referring * 100, 2) AS unresolved_pct, CASE WHEN round(unresolved / referring * 100, 2) > 50 THEN 'WARN' ELSE 'PASS' END AS status FROM g"),
    "row_drift": (row_drift, "WITH g AS (SELECT source AS name, nullif(count(*) FILTER (WHERE lang = 'en'), 0) AS previous, count(*) AS n FROM documents GROUP BY 1) SELECT *, round(abs(n - previous) / previous, 4) AS change, CASE WHEN abs(n - previous) / previous > 0.5 THEN 'WARN' ELSE 'PASS' END AS status FROM g"),
    "gate_rollup": (gate_rollup, "SELECT p_brand, CASE WHEN max(p_size) > 48 THEN 'BLOCKED' WHEN max(p_size) > 40 THEN 'WARNINGS' ELSE 'PASSED' END AS status FROM part GROUP BY 1"),
    "status_rollup": (status_rollup, "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS committed, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS other, min(o_orderdate) AS earliest, max(o_orderdate) AS latest FROM orders GROUP BY 1"),
    "group_rollup": (group_rollup, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))"),
    "table_search_page": (table_search_page, "SELECT * FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_brand), 'widget') OR contains(lower(p_type), 'widget') ORDER BY p_partkey LIMIT 20 OFFSET 5"),
    "chunk_text": (chunk_text, "WITH c AS (SELECT doc_id, coalesce(text, '') AS s, unnest(range(0, greatest(1, length(coalesce(text, '')) - 100), 900)) AS p FROM documents) SELECT doc_id, (p // 900)::BIGINT AS chunk, length(substr(s, p + 1, 1000)) AS n_chars, md5(substr(s, p + 1, 1000)) AS digest FROM c"),
    "parse_log_lines": (parse_log_lines, "SELECT event_id, CASE WHEN ok THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS logged_at, CASE WHEN ok THEN CASE WHEN value > 90 THEN 'ERROR' ELSE 'INFO' END END AS level, CASE WHEN ok THEN event_type END AS message FROM (SELECT *, event_id % 11 <> 0 AS ok FROM events)"),
    "log_facets": (log_facets, "SELECT level, source, count(*) AS n FROM (SELECT CASE WHEN value > 90 THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS source FROM events) GROUP BY GROUPING SETS ((level), (source))"),
    "doc_ledger_resume": (doc_ledger_resume, "SELECT doc_id, md5(text) AS fingerprint FROM documents WHERE doc_id % 6 <> 0"),
    "integrated_view": (integrated_view, "SELECT d.doc_id, source, lang, coalesce(q, -1) AS quality FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)"),
    "numeric_limits": (
        numeric_limits,
        "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 3 THEN 1100.0::DOUBLE + p_size WHEN 4 THEN p_size + 0.5::DOUBLE WHEN 6 THEN -100.0::DOUBLE * p_size END AS value, CASE p_partkey % 8 WHEN 1 THEN 'placeholder' WHEN 2 THEN 'non-numeric:' || trim(p_name)[1:40] WHEN 7 THEN 'placeholder' END AS reason FROM part",
    ),
    "coerce_values": (coerce_values, "SELECT o_orderkey, try_cast(nullif(regexp_extract(o_orderpriority, '-?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) AS priority, o_orderstatus = 'O' AS is_open, o_orderkey * 1000 AS ms FROM orders"),
    "distinct_values": (distinct_values, "SELECT DISTINCT p_brand, p_type FROM part"),
    "set_difference": (set_difference, "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier"),
}
