"""Queries on sources' headers and files, runs, reviews and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagwright.operators import runs
from tagwright.plans.series import table
from tagwright.sources import headers
from tagwright.sources.shared import shared_folder
from tagwright.streaming import live


def sheet_rows(spark, d):
    """A file a nation: rows of customers, and a header in one of them."""
    c = table(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_nationkey")).alias("file"), F.col("c_custkey").alias("k"), "c_nationkey")
    cells = F.when(F.col("k") % 4 == 1, F.array(F.lit("Tag_Name"), F.lit(" uom "), F.lit("nan"), F.col("file"))).when(F.col("k") % 4 == 2, F.array(F.lit("tag name"), F.lit(""), F.lit("LIMIT\nhigh"), F.lit(None))).when(F.col("k") % 4 == 3, F.array(F.lit("Parent"), F.lit("Attribute"), F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))
    return c.select("file", F.floor(F.col("k") / 25).cast("int").alias("row"), "k", cells.alias("cells"))


SHEETS = "s AS (SELECT 'f' || c_nationkey AS file, c_custkey // 25 AS row, c_custkey % 4 AS m FROM customer WHERE c_custkey // 25 < 15)"


def header_sniff(spark, d):
    return headers.header_row(sheet_rows(spark, d).withColumn("row", F.col("row").cast("long")), ["tag_name", "UOM", "limit high"]).withColumns({c: F.col(c).cast("long") for c in ("matched", "filled")})


HEADER_SNIFF = f"""WITH {SHEETS}, c AS (SELECT file, row, CASE WHEN m IN (1, 2) THEN 2 ELSE 0 END AS matched, CASE m WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 4 END AS filled FROM s)
SELECT DISTINCT file, row, matched, filled FROM c QUALIFY row_number() OVER (PARTITION BY file ORDER BY matched DESC, filled DESC, row) = 1"""


def source_detect(spark, d):
    return headers.detected_source(sheet_rows(spark, d), {"pi": ["Parent", "attribute"], "historian": ["tag name", "uom"]}).withColumn("n_sources", F.col("n_sources").cast("long"))


SOURCE_DETECT = f"WITH {SHEETS}, c AS (SELECT file, max(m = 3)::INT AS pi, max(m = 1)::INT AS historian FROM s GROUP BY 1) SELECT file, CASE WHEN pi + historian = 1 THEN CASE WHEN pi = 1 THEN 'pi' ELSE 'historian' END END AS source, (pi + historian)::BIGINT AS n_sources FROM c"


def sap_table_detect(spark, d):
    f = table(spark, d, "nation").select("n_nationkey", F.expr("CASE n_nationkey % 4 WHEN 0 THEN array('aufnr', 'x', 'auart') WHEN 1 THEN array('EQUNR', 'TPLNR') WHEN 2 THEN array('zzz') ELSE array('AUFNR', 'EQUNR') END").alias("columns"))
    return headers.detected_table(f, {"AUFK": ["AUFNR", "AUART", "WERKS"], "EQUI": ["EQUNR", "TPLNR", "EQART", "HERST"], "IFLO": ["TPLNR"]}, "n_nationkey")


SAP_DETECT = "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'AUFK' WHEN 1 THEN 'EQUI' WHEN 3 THEN 'AUFK' END AS table, CASE n_nationkey % 4 WHEN 0 THEN 0.6667 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 0.3333 END::DOUBLE AS score FROM nation"


def excursion_blocks(spark, d):
    e = table(spark, d, "events").select(F.expr("event_id div 90").alias("file"), "event_id", F.expr("CASE WHEN event_id % 9 = 0 THEN concat('alarm ', event_id) ELSE ' ' END").alias("summary"), F.expr("CASE WHEN event_id % 9 IN (4, 6) AND event_id % 2 = 0 THEN concat('P-', event_id div 9 % 7) END").alias("equipment"))
    return headers.blocks(e, "file", "event_id", "summary", "equipment")


EXCURSIONS = """WITH e AS (SELECT event_id // 90 AS file, event_id, event_id % 9 = 0 AS m, CASE WHEN event_id % 9 IN (4, 6) AND event_id % 2 = 0 THEN 'P-' || (event_id // 9) % 7 END AS q FROM events), b AS (SELECT *, count(*) FILTER (m) OVER (PARTITION BY file ORDER BY event_id) AS block FROM e)
SELECT file, block - 1 AS block, min(event_id) FILTER (m) AS event_id, min(q) AS equipment FROM b WHERE block > 1 GROUP BY file, block"""


def file_kinds(spark, d):
    body = F.expr("CASE p_partkey % 7 WHEN 0 THEN concat(unhex('504B0304'), encode('..xl/workbook.xml', 'UTF-8')) WHEN 1 THEN concat(unhex('504B0304'), encode('word/document.xml', 'UTF-8')) WHEN 2 THEN encode(concat('%PDF', repeat('x', p_size * 4)), 'UTF-8') WHEN 3 THEN concat(unhex('D0CF11E0A1B11AE1'), encode(repeat('o', p_size * 20), 'UTF-8')) WHEN 4 THEN encode('', 'UTF-8') WHEN 5 THEN encode('a,b', 'UTF-8') ELSE unhex('FF41') END")
    return table(spark, d, "part").select("p_partkey", headers.file_kind(body).alias("kind"))


FILE_KINDS = "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'docx' WHEN 2 THEN CASE WHEN 4 + p_size * 4 > 100 THEN 'pdf' END WHEN 3 THEN CASE WHEN 8 + p_size * 20 > 512 THEN 'ole' END WHEN 5 THEN 'text' END AS kind FROM part"


def required_files(spark, d):
    f = table(spark, d, "part").select(F.concat("p_brand", F.lit(".csv")).alias("name"), (F.col("p_size") - 1).alias("length"))
    return headers.required_files(f, {"^Brand#1": 1, "^Brand#2": 10_000_000, "^None": 0})


REQUIRED_FILES = """WITH f AS (SELECT p_brand, p_size = 1 AS z FROM part), g AS (SELECT '^Brand#1' AS pattern, 1 AS least, count(*) AS n, count(*) FILTER (z) AS zs FROM f WHERE starts_with(p_brand, 'Brand#1') UNION ALL SELECT '^Brand#2', 10000000, count(*), count(*) FILTER (z) FROM f WHERE starts_with(p_brand, 'Brand#2') UNION ALL SELECT '^None', 0, 0, 0)
SELECT pattern, n AS n_files, zs AS zero_bytes, CASE WHEN n < least OR zs > 0 THEN 'BLOCK' ELSE 'PASS' END AS status FROM g"""


def failure_modes(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("i"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END").alias("mode"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END").alias("eq"), F.expr("CASE WHEN p_size % 2 = 0 THEN cast(p_size AS STRING) ELSE 'n/a' END").try_cast("int").alias("severity"))
    return runs.failure_table(p, "p1", "FM", "mode", "eq", "i", ["severity"])


FAILURE_MODES = """SELECT 'p1' AS plant_code_id, CASE WHEN p_partkey % 3 = 0 THEN 'FM_' ELSE 'FM_' || p_brand || '_' END || lpad(p_partkey::VARCHAR, greatest(3, length(p_partkey::VARCHAR))::INT, '0') AS code, trim(p_name) AS text, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS equipment_id, CASE WHEN p_size % 2 = 0 THEN p_size END AS severity FROM part WHERE p_partkey % 4 <> 0"""


def review_list(spark, d):
    o = table(spark, d, "orders").select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat('r', o_custkey) END").alias("record_id"), "o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("seq"))
    return runs.review_list(o, "record_id", ["o_orderstatus", "o_orderpriority"], "seq")


REVIEW_LIST = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'r' || o_custkey END AS record_id, o_orderstatus, o_orderpriority, o_orderkey AS seq FROM orders QUALIFY row_number() OVER (PARTITION BY coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'r' || o_custkey END, 'o' || o_orderstatus || '|' || o_orderpriority) ORDER BY o_orderkey) = 1"


def job_progress(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.expr("CASE event_id % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'read' ELSE 'match' END").alias("phase"), "value", F.lit(100.0).alias("total"))
    return runs.progress(e, "user_id", "event_id", "phase", "value", "total", {"read": 20, "match": 50, "write": 30}).select("user_id", "event_id", "percent")


JOB_PROGRESS = "WITH m AS (SELECT *, least(1, coalesce(value, 0) / 100) AS s FROM events), p AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 70 + 30 * s WHEN 1 THEN 20 * s ELSE 20 + 50 * s END::DOUBLE AS p FROM m) SELECT user_id, event_id, round(max(p) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS percent FROM p"


def run_causes(spark, d):
    out = F.expr("concat_ws('\\n', 'start', CASE p_partkey % 5 WHEN 0 THEN concat('  error: TOOmanyrequests ', p_partkey) WHEN 1 THEN 'No source data found here' WHEN 2 THEN 'fine' ELSE '' END, '')")
    return table(spark, d, "part").select("p_partkey", runs.cause(F.when(F.col("p_partkey") % 5 == 4, F.lit(" ")).otherwise(out)).alias("c")).select("p_partkey", "c.*")


RUN_CAUSES = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'gemini_rate_limited' WHEN 1 THEN 'no_source_data' WHEN 4 THEN 'empty_output' ELSE 'zero_rows_unknown_cause' END AS category, CASE p_partkey % 5 WHEN 0 THEN 'error: TOOmanyrequests ' || p_partkey WHEN 1 THEN 'No source data found here' WHEN 2 THEN 'fine' WHEN 3 THEN 'start' ELSE '' END AS evidence FROM part"


def flow_state(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.expr("CASE WHEN value > 25 THEN event_type END").alias("stage"), F.expr("CASE WHEN event_id % 2 = 0 THEN event_id * 3 END").alias("rows"))
    return runs.flow_now(e, ["user_id"], "event_id", ["stage", "rows"])


FLOW_STATE = "SELECT user_id, arg_max(event_type, event_id) FILTER (value > 25) AS stage, arg_max(event_id * 3, event_id) FILTER (event_id % 2 = 0) AS rows, count(*) AS n_events FROM events GROUP BY 1"


def interrupted_jobs(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END").alias("status"))
    return runs.interrupted(o, table(spark, d, "orders").where("o_custkey % 2 = 0"), "o_orderkey")


def breadcrumbs(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return runs.breadcrumbs(e, "user_id", "event_id", 3)


BREADCRUMBS = "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3"


def nested_permissions(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey", "concat('p', o_orderkey % 2) AS plant", "o_orderstatus AS feature", "substring(o_orderpriority, 1, 1) AS letter")
    out = runs.permissions(o, "o_custkey", "plant", "feature", "letter")
    return out.select("o_custkey", *[F.get_json_object(F.try_element_at("granted", F.lit(p)), "$.O").alias(p) for p in ("p0", "p1")])


PERMISSIONS = "WITH g AS (SELECT o_custkey, o_orderkey % 2 AS p, array_to_string(list_sort(list_distinct(list(o_orderpriority[1]))), '') AS l FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) SELECT c.o_custkey, max(l) FILTER (p = 0) AS p0, max(l) FILTER (p = 1) AS p1 FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN g USING (o_custkey) GROUP BY 1"


def label_check(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN array('z', 'b', 'a') WHEN 1 THEN array('q') WHEN 2 THEN array('a', 'c') ELSE array() END").cast("array<string>").alias("l"))
    return runs.label_errors(p, "p_partkey", "l", ["a", "b", "c"]).select("p_partkey", F.array_join("labels", ",").alias("labels"), F.array_join("unknown", ",").alias("unknown"), "missing")


LABELS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a,b' WHEN 2 THEN 'a,c' ELSE '' END AS labels, CASE p_partkey % 4 WHEN 0 THEN 'z' WHEN 1 THEN 'q' ELSE '' END AS unknown, p_partkey % 4 IN (1, 3) AS missing FROM part"


def upload_manifest(spark, d):
    f = lambda where: table(spark, d, "customer").where(where).select("c_name")
    return runs.manifest(f("c_custkey % 2 = 0"), f("c_custkey % 3 = 0"), "c_name")


def custom_joins(spark, d):
    t = {n: table(spark, d, n) for n in ("customer", "nation", "region", "orders")}
    out = runs.joined(t, "orders", [("customer", [("o_custkey", "c_custkey")], "inner"), ("nation", [("c_nationkey", "n_nationkey")], "left"), ("region", [("n_regionkey", "r_regionkey")], "left")])
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


def stored_stream(spark, d, name):
    """events as a stream of files, and a checkpoint and an output folder beside each other."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    e.repartition(3).write.parquet(f"{folder}/in")
    return live.samples(spark, f"{folder}/in", "event_id long, event_type string, value double, ts timestamp, user_id long"), folder


def stream_dedup(spark, d):
    stream, folder = stored_stream(spark, d, "dedup")
    once = live.once_each(stream, ["user_id", "event_type"], "ts", "400 days")
    once.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{folder}/out").select("user_id", "event_type")


def stream_window_quality(spark, d):
    stream, folder = stored_stream(spark, d, "windows")
    stats = live.window_quality(stream, "event_type", "ts", "value", "1 day", late="0 seconds")

    def keep(batch, n):
        batch.write.mode("append").parquet(f"{folder}/out")

    stats.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").groupBy(F.col("w.start").cast("date").cast("string").alias("day"), "event_type").agg(F.max("samples").alias("samples"), F.min("low").alias("low"), F.max("high").alias("high"))
    return rows


QUERIES = {
    "header_sniff": (header_sniff, HEADER_SNIFF),
    "source_detect": (source_detect, SOURCE_DETECT),
    "sap_table_detect": (sap_table_detect, SAP_DETECT),
    "excursion_blocks": (excursion_blocks, EXCURSIONS),
    "file_kinds": (file_kinds, FILE_KINDS),
    "required_files": (required_files, REQUIRED_FILES),
    "failure_modes": (failure_modes, FAILURE_MODES),
    "review_list": (review_list, REVIEW_LIST),
    "job_progress": (job_progress, JOB_PROGRESS),
    "run_causes": (run_causes, RUN_CAUSES),
    "flow_state": (flow_state, FLOW_STATE),
    "interrupted_jobs": (interrupted_jobs, "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'done' WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'interrupted' END AS status FROM orders"),
    "breadcrumbs": (breadcrumbs, BREADCRUMBS),
    "nested_permissions": (nested_permissions, PERMISSIONS),
    "label_check": (label_check, LABELS),
    "upload_manifest": (upload_manifest, "SELECT c_name, CASE WHEN c_custkey % 2 = 0 THEN 'undescribed' ELSE 'stray' END AS state FROM customer WHERE (c_custkey % 2 = 0) <> (c_custkey % 3 = 0)"),
    "custom_joins": (custom_joins, "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"),
    "stream_window_quality": (stream_window_quality, "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS samples, min(value) AS low, max(value) AS high FROM events GROUP BY ALL"),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id, event_type FROM events"),
}
