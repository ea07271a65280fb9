"""Queries on documents' pages and drawings, resumed extraction, edits that go back to tables, uploads of graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.functions import drawings, pages
from tagwright.operators import entities, intake, resume, sync
from tagwright.plans.series import table
from tagwright.plans.shapes import scratch
from tagwright.sources import framed

LIMIT, OVERLAP = 300, 50


def page_chunks(spark, d):
    """Documents whose lines are pages, packed."""
    # an inner explode infers a filter on its array and works it out again for it
    docs = table(spark, d, "documents").select("doc_id", F.posexplode_outer(pages.packed(F.split("text", "\n"), LIMIT, OVERLAP)).alias("chunk", "c")).where("chunk is not null")
    return docs.select("doc_id", F.col("chunk").cast("long").alias("chunk"), pages.pages_label("c.page_start", "c.page_end").alias("pages"), F.md5("c.text").alias("digest"))


PAGE_CHUNKS = f"""WITH RECURSIVE p AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS pages FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(pages) + 1)) AS no, unnest(list_transform(pages, lambda x: length(x))) AS n FROM p),
r AS (SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS first, 0::BIGINT AS held, NULL::BIGINT AS closed, NULL::BIGINT AS began, NULL::BIGINT AS alone FROM p UNION ALL
 SELECT doc_id, no, CASE WHEN n = 0 THEN first WHEN n > {LIMIT} THEN no + 1 WHEN held = 0 OR held + n > {LIMIT} THEN no ELSE first END,
  CASE WHEN n = 0 THEN held WHEN n > {LIMIT} THEN 0 WHEN held > 0 AND held + n > {LIMIT} THEN n + 1 ELSE held + n + 1 END,
  CASE WHEN n > 0 AND held > 0 AND (n > {LIMIT} OR held + n > {LIMIT}) THEN no - 1 END, first, CASE WHEN n > {LIMIT} THEN no END
 FROM r JOIN l USING (doc_id) WHERE no = i + 1),
s AS (SELECT doc_id, began AS a, closed AS b, true AS whole FROM r WHERE closed IS NOT NULL UNION ALL SELECT doc_id, alone, alone, false FROM r WHERE alone IS NOT NULL
 UNION ALL SELECT doc_id, first, i, true FROM r JOIN p USING (doc_id) WHERE i = len(pages) AND held > 0),
t AS (SELECT doc_id, a, b, whole, array_to_string(list_filter(pages[a:b], lambda x: x <> ''), chr(10)) AS own FROM s JOIN p USING (doc_id)),
c AS (SELECT doc_id, a, b, 1 AS k, own AS text FROM t WHERE whole UNION ALL SELECT doc_id, a, b, k, substr(own, k, {LIMIT}) FROM (SELECT *, unnest(range(1, length(own) + 1, {LIMIT - OVERLAP})) AS k FROM t WHERE NOT whole))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, k) - 1 AS chunk, CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END AS pages, md5(text) AS digest FROM c"""


def drawing_texts(spark, d):
    """Extracted texts of drawings, a part each: whole, cut off, as JSON, arrows only, none."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    whole = F.concat(F.lit("--- DRAWING NUMBER ---\n DWG-"), k, F.lit("-A1 \n--- COMPONENTS ---\r\n| Tag | Type | Description | BBox |\n| --- | --- | --- | --- |\n| P-"), k, F.lit(" | Pump | "), name, F.lit(" | [1, 2] |\n\n|**V-"), k, F.lit("**|Valve| | |\nno row\n**--- Connections ---**\n| From | To |\n|---|---|\n| P-"), k, F.lit(" | V-"), k, F.lit(" |\n| alone |\n"))
    cut = F.concat(F.lit("see AB-12"), k, F.lit("\n* Components *\nTag | Type\nP-"), k, F.lit("|Pump|"), name)
    json = F.concat(F.lit('noise [{"box_2d": [1,2, '), k, F.lit('], "label": "FV-'), k, F.lit('"}, {"label": " "},\n {"point": "here", "label": "a\\nb "}] end\nA'), k, F.lit(" -> B"), k, F.lit("..\n- C → D → E"))
    arrows = F.concat(F.lit("• X"), k, F.lit("→Y\n→ nothing\n * Z -> W"), k, F.lit(". "))
    parts = table(spark, d, "part").select("p_partkey", "p_name").repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes that make much work: one file must not be one task
    return parts.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, whole).when(F.col("p_partkey") % 5 == 1, cut).when(F.col("p_partkey") % 5 == 2, json).when(F.col("p_partkey") % 5 == 3, arrows).alias("text"))


def drawing_components(spark, d):
    rows = drawing_texts(spark, d).select("p_partkey", drawings.drawing_number("text").alias("drawing"), F.posexplode_outer(drawings.components("text")).alias("place", "c")).where("place is not null")
    return rows.select("p_partkey", "drawing", F.col("place").cast("long").alias("place"), "c.*")


def drawing_connections(spark, d):
    rows = drawing_texts(spark, d).select("p_partkey", F.posexplode_outer(drawings.connections("text")).alias("place", "c")).where("place is not null")
    return rows.select("p_partkey", F.col("place").cast("long").alias("place"), "c.*")


DRAWING_COMPONENTS = """SELECT p_partkey, 'DWG-' || p_partkey || '-A1' AS drawing, 0 AS place, 'P-' || p_partkey AS tag, 'Pump' AS type, p_name AS description, '[1, 2]' AS bbox FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'DWG-' || p_partkey || '-A1', 1, 'V-' || p_partkey, 'Valve', '', '' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'AB-12' || p_partkey, 0, 'P-' || p_partkey, 'Pump', p_name, '' FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, CASE WHEN p_partkey > 99 THEN 'FV-' || p_partkey ELSE 'Unknown' END, 0, 'FV-' || p_partkey, 'Valve/Instrument', '', '[1, 2, ' || p_partkey || ']' FROM part WHERE p_partkey % 5 = 2
UNION ALL SELECT p_partkey, CASE WHEN p_partkey > 99 THEN 'FV-' || p_partkey ELSE 'Unknown' END, 1, 'a / b', 'Unknown', '', 'here' FROM part WHERE p_partkey % 5 = 2"""

DRAWING_CONNECTIONS = """SELECT p_partkey, 0 AS place, 'P-' || p_partkey AS source, 'V-' || p_partkey AS target FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 0, 'A' || p_partkey, 'B' || p_partkey FROM part WHERE p_partkey % 5 = 2 UNION ALL SELECT p_partkey, 1, 'C', 'D → E' FROM part WHERE p_partkey % 5 = 2
UNION ALL SELECT p_partkey, 0, 'X' || p_partkey, 'Y' FROM part WHERE p_partkey % 5 = 3 UNION ALL SELECT p_partkey, 1, 'Z', 'W' || p_partkey FROM part WHERE p_partkey % 5 = 3"""


def _chunk_tables(spark, d):
    """Orders as files of as many chunks as they have lines, and a ledger that knows three of four."""
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("chunk"))
    n = chunks.groupBy("file").agg(F.count("*").alias("n"))
    lost = F.expr("IF(file % 4 = 2, array(), array(1L, 3L, 99L))").cast("array<long>")
    ledger = n.where("file % 4 < 3").select("file", (F.col("n") + (F.col("file") % 4 == 1).cast("long")).alias("n_chunks"), lost.alias("failed"))
    return chunks, ledger


def resumed_rows(spark, d):
    """Rows after a run that does again what was lost."""
    chunks, ledger = _chunk_tables(spark, d)
    todo = resume.to_do(chunks, ledger)
    old = chunks.where("file % 4 < 3 and (file % 4 <> 0 or chunk not in (1, 3))").withColumn("run", F.lit("old"))
    return resume.merged(old, todo.withColumn("run", F.lit("new")), todo, chunks, ledger)


RESUMED = """SELECT l_orderkey AS file, l_linenumber::BIGINT AS chunk, CASE WHEN l_orderkey % 4 = 2 OR (l_orderkey % 4 = 0 AND l_linenumber NOT IN (1, 3)) THEN 'old' ELSE 'new' END AS run FROM lineitem"""


def resumed_ledger(spark, d):
    """The ledger after a run in which the second chunk of every file was lost, if it was done."""
    chunks, ledger = _chunk_tables(spark, d)
    done = resume.to_do(chunks, ledger).withColumn("ok", F.col("chunk") != 2)
    return resume.new_ledger(chunks, done, ledger).select("file", "n_chunks", F.array_join(F.col("failed").cast("array<string>"), ",").alias("failed"))


RESUMED_LEDGER = """WITH n AS (SELECT l_orderkey AS file, count(*) AS n, count(*) FILTER (l_linenumber IN (1, 3)) AS again, max((l_linenumber = 2)::INT) AS has_2 FROM lineitem GROUP BY 1)
SELECT file, n AS n_chunks, CASE WHEN file % 4 IN (0, 2) THEN '' WHEN has_2 = 1 THEN '2' ELSE '' END AS failed FROM n WHERE file % 4 <> 0 OR again > 0
UNION ALL SELECT file, n, '1,3,99' FROM n WHERE file % 4 = 0 AND again = 0"""


def _sheets(spark, d):
    return table(spark, d, "part").selectExpr("concat(p_brand, ' list.v2.pdf') AS file", "'manual' AS document_type", "p_partkey AS chunk", "p_size AS position", "p_partkey % 4 AS page_start", "p_partkey % 4 + p_size % 2 AS page_end", "map('Tag', IF(p_partkey % 3 = 0, 'NaN', concat(' t', p_size)), 'Name', IF(p_partkey % 4 = 0, null, p_name), 'Tag No.', IF(p_partkey % 2 = 0, '  ', p_type)) AS values")


def document_records(spark, d):
    """Entries of parts' sheets as rows of records; every tenth chunk has a blank entry before its own."""
    p = _sheets(spark, d)
    blank = p.where("chunk % 10 = 0").withColumns({"position": F.lit(-1), "values": F.expr("map('Tag', ' ', 'Name', null)")})
    return resume.record_rows(p.union(blank)).withColumn("position", F.col("position").cast("long"))


_STEM, _SHA = "upper(replace((p_brand || ' list.v2')[1:{n}], ' ', '_'))", "upper(sha1(p_brand || ' list.v2.pdf|manual{more}')[1:12])"
_PARTS = """WITH p AS (SELECT *, CASE WHEN p_partkey % 3 > 0 THEN 't' || p_size END AS tag, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 2 = 1 THEN p_type END AS no, p_partkey % 4 AS a, p_partkey % 4 + p_size % 2 AS b FROM part)
"""
DOCUMENT_RECORDS = _PARTS + f"""SELECT 'DOC-' || {_STEM.format(n=20)} || '-' || {_SHA.format(more='')} AS document_id, 'REC-' || {_STEM.format(n=16)} || '-' || {_SHA.format(more="|row' || p_partkey || '.0")} AS record_id, p_brand || ' list.v2.pdf' AS file, 'manual' AS document_type,
 p_partkey AS chunk, 0 AS position, coalesce(no, tag, '') AS equipment_tag, concat_ws(' | ', 'Tag: ' || tag, 'Name: ' || name, 'Tag No.: ' || no) AS extracted_entities, a AS page_start, b AS page_end, CASE WHEN a <= 0 THEN '' WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END AS source_pages
FROM p WHERE p_partkey % 3 = 0 OR tag IS NOT NULL OR name IS NOT NULL OR no IS NOT NULL"""


def document_tables(spark, d):
    """Rows of parts' tables as records, two columns of three told."""
    p = _sheets(spark, d).selectExpr("file", "document_type", "IF(chunk % 5 = 0, null, concat('sheet ', chunk % 3)) AS sheet", "chunk % 3 AS ordinal", "chunk AS idx", "values")
    return resume.tabular_rows(p, ["Name", "Tag", "None"])


DOCUMENT_TABLES = _PARTS + f"""SELECT 'DOC-' || {_STEM.format(n=20)} || '-' || {_SHA.format(more='')} AS document_id, 'REC-' || {_STEM.format(n=16)} || '-' || {_SHA.format(more="|row' || CASE WHEN p_partkey % 5 > 0 THEN 'sheet ' || p_partkey % 3 || '!' ELSE '' END || p_partkey || '")} AS record_id, p_brand || ' list.v2.pdf' AS file, 'manual' AS document_type,
 p_partkey % 3 AS chunk, coalesce(no, tag, '') AS equipment_tag, concat_ws(' | ', 'Name: ' || name, 'Tag: ' || tag) AS extracted_entities, 0 AS page_start, 0 AS page_end, CASE WHEN p_partkey % 5 > 0 THEN 'sheet ' || p_partkey % 3 ELSE '' END AS source_pages FROM p"""

KEYS = {"equipment_pid": "pid_uid", "equipment_sap": "sap_uid", "timeseries_metadata": "ts_uid"}
COLUMNS = {"equipment_pid": ["pid_uid", "normalized_asset", "area"], "equipment_sap": ["sap_uid", "pid_uid", "normalized_asset", "weight"], "timeseries_metadata": ["ts_uid", "unit"]}
ALLOWED = {"Equipment": ["equipment_pid", "equipment_sap"], "Sensor": ["timeseries_metadata"]}


def _edited_nodes(spark, d):
    p = table(spark, d, "part").where("p_partkey < 1500").selectExpr("concat(p_partkey, IF(p_partkey % 11 = 0, '', '#equipment_pid')) AS node_id", "'Equipment' AS label", "map('name', p_name, 'area', p_brand, 'other', 'x') AS properties", "map('name', IF(p_partkey % 3 = 0, 'ui_update', 'sap'), 'area', IF(p_partkey % 5 = 0, 'ui_update', 'sap'), 'other', 'ui_update', 'source', 'sap') AS lineage")
    s = table(spark, d, "supplier").selectExpr("concat(s_suppkey, '#timeseries_metadata')", "'Sensor'", "map('unit', s_name, 'note', 'x')", "map('source', IF(s_suppkey % 7 = 0, 'ui_update', 'ts'), 'unit', IF(s_suppkey % 14 = 1, 'ui_update', 'ts'))")
    return p.union(s)


def graph_table_edits(spark, d):
    return sync.table_edits(_edited_nodes(spark, d), KEYS, COLUMNS, ALLOWED, {("Equipment", "name"): "normalized_asset"})


GRAPH_TABLE_EDITS = """WITH p AS (SELECT * FROM part WHERE p_partkey < 1500 AND p_partkey % 11 > 0)
SELECT unnest(['equipment_pid', 'equipment_sap']) AS "table", 'pid_uid' AS key_column, p_partkey::VARCHAR AS key, 'normalized_asset' AS "column", p_name AS value FROM p WHERE p_partkey % 3 = 0
UNION ALL SELECT 'equipment_pid', 'pid_uid', p_partkey::VARCHAR, 'area', p_brand FROM p WHERE p_partkey % 5 = 0
UNION ALL SELECT 'timeseries_metadata', 'ts_uid', s_suppkey::VARCHAR, 'unit', s_name FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 14 = 1"""


def synced_table(spark, d):
    """A table after the edits of its rows and of the drawings' nodes that its rows refer to."""
    t = table(spark, d, "part").selectExpr("p_partkey AS sap_uid", "p_partkey * 2 AS pid_uid", "p_type AS normalized_asset", "p_size AS weight")
    weights = spark.createDataFrame([("equipment_sap", "sap_uid", "6", "weight", "-1"), ("equipment_sap", "sap_uid", "7", "weight", "none"), ("equipment_sap", "sap_uid", "0", "weight", "9")], "table string, key_column string, key string, column string, value string")
    return sync.with_edits(t, graph_table_edits(spark, d).unionByName(weights), "equipment_sap")


SYNCED = """SELECT t.p_partkey AS sap_uid, t.p_partkey * 2 AS pid_uid, coalesce(q.p_name, t.p_type) AS normalized_asset, CASE t.p_partkey WHEN 0 THEN 9 WHEN 6 THEN -1 WHEN 7 THEN NULL ELSE t.p_size END AS weight
FROM part t LEFT JOIN part q ON q.p_partkey = t.p_partkey * 2 AND q.p_partkey < 1500 AND q.p_partkey % 11 > 0 AND q.p_partkey % 3 = 0"""


def missing_links(spark, d):
    """Links of suppliers to parts that the table of connections hasn't."""
    s, p, li = (table(spark, d, t) for t in ("supplier", "part", "lineitem"))
    nodes = s.selectExpr("concat('s', s_suppkey) AS node_id", "s_name AS name", "map('equipment_id', IF(s_suppkey % 2 = 0, concat('E', s_suppkey % 20), '')) AS properties").union(p.where("p_partkey % 9 > 0").selectExpr("concat('p', p_partkey)", "IF(p_partkey % 10 = 0, '', p_name)", "map('normalized_asset', IF(p_partkey % 3 = 0, p_brand, null))"))
    edges = li.selectExpr("l_orderkey * 10 + l_linenumber AS relationship_id", "concat('s', l_suppkey) AS from_node_id", "concat('p', l_partkey) AS to_node_id", "IF(l_returnflag = 'N', 'CONNECTED_TO', concat('T', l_returnflag)) AS rel_type")
    stored = s.where("s_suppkey % 4 = 0").selectExpr("concat('E', s_suppkey % 20) AS from_ref").distinct().join(p.selectExpr("p_brand AS to_ref").distinct())
    both = [sync.missing_links(nodes, edges, stored, c).withColumn("connected", F.lit(c)) for c in (True, False)]
    return both[0].union(both[1])


MISSING_LINKS = """WITH n AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'E' || s_suppkey % 20 ELSE s_name END AS ref FROM supplier UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END FROM part WHERE p_partkey % 9 > 0),
st AS (SELECT DISTINCT 'E' || s_suppkey % 20 AS a, p_brand AS b FROM supplier, part WHERE s_suppkey % 4 = 0),
e AS (SELECT l_orderkey * 10 + l_linenumber AS id, a.ref AS from_ref, b.ref AS to_ref, CASE WHEN l_returnflag = 'N' THEN 'CONNECTED_TO' ELSE 'T' || l_returnflag END AS t FROM lineitem JOIN n a ON a.id = 's' || l_suppkey JOIN n b ON b.id = 'p' || l_partkey WHERE a.ref IS NOT NULL AND b.ref IS NOT NULL)
SELECT from_ref, to_ref, arg_min(t, id) AS rel_type, t = 'CONNECTED_TO' AS connected FROM e WHERE NOT EXISTS (FROM st WHERE st.a = from_ref AND st.b = to_ref) GROUP BY from_ref, to_ref, t = 'CONNECTED_TO'"""


def _uploaded(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    empty = "map('k', ' ')"
    nodes = s.selectExpr("s_suppkey AS row", "IF(s_suppkey % 9 = 0, ' ', 'Pump') AS label", "IF(s_suppkey % 13 = 0, null, concat(' pump ', s_suppkey % 80, ' ')) AS name", "map('k', s_name) AS properties")
    edges = c.selectExpr("c_custkey AS row", "IF(c_custkey % 7 = 0, null, 'FEEDS') AS rel_type", "IF(c_custkey % 14 = 0, ' ', concat('pump ', c_custkey % 90)) AS from_name", "IF(c_custkey % 28 = 0, null, concat('tank ', c_custkey % 20)) AS to_name", f"IF(c_custkey % 56 = 0, {empty}, map('k', c_name)) AS properties")
    stored = s.selectExpr("concat('old', s_suppkey) AS node_id", "IF(s_suppkey % 2 = 0, concat('tank ', s_suppkey % 15), concat('pump ', s_suppkey % 5)) AS name")
    return sync.upload("b1", nodes, edges, stored)


def graph_upload(spark, d):
    """Nodes and edges of an upload, ids by what they were made from."""
    nodes, edges, _ = _uploaded(spark, d)
    ends = nodes.select("node_id", F.concat(F.lit("new "), "name", F.lit(" "), "properties.k").alias("n"))
    named = lambda side: ends.select(F.col("node_id").alias(f"{side}_node_id"), F.col("n").alias(side))
    told = edges.join(named("from"), "from_node_id", "left").join(named("to"), "to_node_id", "left")
    return nodes.select(F.lit("node").alias("kind"), F.col("label").alias("a"), F.col("name").alias("b"), "properties.k").union(told.select("rel_type", F.coalesce("from", "from_node_id"), F.coalesce("to", "to_node_id"), "properties.k"))


def graph_upload_rejects(spark, d):
    return _uploaded(spark, d)[2]


_UPLOAD = """WITH n AS (SELECT s_suppkey AS "row", CASE WHEN s_suppkey % 9 > 0 THEN 'Pump' END AS label, CASE WHEN s_suppkey % 13 > 0 THEN 'pump ' || s_suppkey % 80 END AS name, s_name AS k FROM supplier),
g AS (SELECT * FROM n WHERE label IS NOT NULL AND name IS NOT NULL),
e AS (SELECT c_custkey AS "row", CASE WHEN c_custkey % 7 > 0 THEN 'FEEDS' END AS t, CASE WHEN c_custkey % 14 > 0 THEN 'pump ' || c_custkey % 90 END AS a, CASE WHEN c_custkey % 28 > 0 THEN 'tank ' || c_custkey % 20 END AS b, c_name AS k FROM customer WHERE c_custkey % 56 > 0),
o AS (SELECT 'old' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'tank ' || s_suppkey % 15 ELSE 'pump ' || s_suppkey % 5 END AS name FROM supplier),
f AS (SELECT name, 'new ' || name || ' ' || arg_max(k, "row") AS id, min("row") AS first FROM g GROUP BY 1),
w AS (SELECT name, id FROM f UNION ALL SELECT name, min(id) FROM o WHERE name NOT IN (SELECT name FROM f) GROUP BY 1),
m AS (SELECT e.*, x.id AS from_id, y.id AS to_id FROM e LEFT JOIN w x ON x.name = a LEFT JOIN w y ON y.name = b WHERE t IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)
"""
GRAPH_UPLOAD = _UPLOAD + "SELECT 'node' AS kind, label AS a, name AS b, k FROM g UNION ALL SELECT t, from_id, to_id, k FROM m WHERE from_id IS NOT NULL AND to_id IS NOT NULL"
GRAPH_UPLOAD_REJECTS = (
    _UPLOAD
    + """SELECT 'node' AS sheet, "row", 'label and name are required' AS reason FROM n WHERE label IS NULL OR name IS NULL UNION ALL SELECT 'node', "row", 'duplicate name ' || name FROM g JOIN f USING (name) WHERE "row" > first
UNION ALL SELECT 'relationship', "row", 'rel_type, from_name and to_name are required' FROM e WHERE t IS NULL OR a IS NULL OR b IS NULL
UNION ALL SELECT 'relationship', "row", 'no node is named ' || CASE WHEN from_id IS NULL THEN a ELSE b END FROM m WHERE from_id IS NULL OR to_id IS NULL"""
)


def series_paths(spark, d):
    """Short names of series: last segments, several segments, whole paths, ids from metadata, names with marks."""
    p = table(spark, d, "part")
    paths = p.selectExpr("p_partkey AS seq", "concat('root.plant', p_partkey % 4, '.', IF(p_partkey % 3 = 0, 'unit.', ''), 'tag_', p_partkey % 700) AS path")
    tags = p.where("p_partkey <= 1200").selectExpr("CASE p_partkey % 6 WHEN 0 THEN concat('tag_', p_partkey) WHEN 1 THEN concat('unit.tag_', p_partkey % 700) WHEN 2 THEN concat('root.x.', p_partkey) WHEN 3 THEN concat('meta', p_partkey) WHEN 4 THEN concat('tag-', p_partkey, '!') ELSE concat('plant', p_partkey % 5, '.tag_', p_partkey) END AS tag")
    ids = p.where("p_partkey % 2 = 1").selectExpr("concat('meta', p_partkey) AS tag", "concat('tag_', p_partkey % 900) AS series_id")
    return sync.resolved_paths(tags, paths, ids)


SERIES_PATHS = """WITH p AS (SELECT p_partkey AS seq, 'root.plant' || p_partkey % 4 || '.' || CASE WHEN p_partkey % 3 = 0 THEN 'unit.' ELSE '' END || 'tag_' || p_partkey % 700 AS path FROM part),
t AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'tag_' || p_partkey WHEN 1 THEN 'unit.tag_' || p_partkey % 700 WHEN 2 THEN 'root.x.' || p_partkey WHEN 3 THEN 'meta' || p_partkey WHEN 4 THEN 'tag-' || p_partkey || '!' ELSE 'plant' || p_partkey % 5 || '.tag_' || p_partkey END AS tag FROM part WHERE p_partkey <= 1200),
i AS (SELECT 'meta' || p_partkey AS tag, 'tag_' || p_partkey % 900 AS id FROM part WHERE p_partkey % 2 = 1),
o AS (SELECT t.tag, coalesce(i.id, regexp_replace(regexp_replace(t.tag, '[.\\s\\-/]', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g')) AS other FROM t LEFT JOIN i ON i.tag = t.tag),
first AS (SELECT x AS name, arg_min(path, seq) AS path FROM (SELECT DISTINCT tag AS x FROM t UNION SELECT other FROM o) JOIN p ON ends_with(path, '.' || x) GROUP BY 1)
SELECT o.tag, CASE WHEN starts_with(o.tag, 'root.') THEN o.tag ELSE coalesce(a.path, b.path) END AS path FROM o LEFT JOIN first a ON a.name = o.tag LEFT JOIN first b ON b.name = o.other"""


LOG_RANGE_MS = (1704844810000, 1704931260000)  # from ten seconds past midnight of a day to a minute past the next


def log_range(spark, d):
    """Events as framed log records in batches of a minute, and those of a day and a little more read back by time."""
    folder = scratch(spark, "framed")
    e = table(spark, d, "events")
    framed.write(e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("logged_ms"), F.concat(F.lit("/e/"), "event_id").alias("endpoint"), F.col("event_type").alias("method"), F.expr("int(200 + event_id % 3)").alias("status"), F.col("value").alias("latency_ms")), folder, first_second=37)
    return framed.read(spark, folder, *LOG_RANGE_MS).select("logged_ms", "endpoint", "method", "status", F.round("latency_ms", 4).alias("latency_ms"))


LOG_RANGE = f"""SELECT epoch_us(ts) // 1000 AS logged_ms, '/e/' || event_id AS endpoint, event_type AS method, (200 + event_id % 3)::INT AS status, round(value, 4) AS latency_ms FROM events WHERE epoch_us(ts) // 1000 BETWEEN {LOG_RANGE_MS[0]} AND {LOG_RANGE_MS[1]}"""


def copied_columns(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return entities.with_copies(s, {"key": "s_suppkey", "s_name": "s_suppkey", "none": "s_city"})


def mapped_headers(spark, d):
    """Customers under headers as people write them, the first of a field winning."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("FUNC. LOCATION"), F.col("c_nationkey").alias("FLOC"), F.col("c_name").alias("Find-ing"), F.col("c_mktsegment").alias("Other"))
    rows, report = entities.map_headers(c, {"functional_location": ["FLOC", "Func Location"], "finding": []}, ["finding", "severity"])
    return rows.withColumns({k: F.lit(",".join(v)) for k, v in report.items()})


FINDINGS = intake.Findings(
    "esd",
    {"finding_no": ["Finding No", "No."], "equipment_ref": ["Equipment Ref"], "severity": [], "detected_on": ["Detected"], "pieces": ["Count"], "note": ["Remarks"]},
    kinds={"detected_on": "date", "pieces": "number"},
    raw={"severity": "severity_raw"},
    words={"severity": {"slight_release": "slight_release"}},
    required=("finding_no",),
    natural_key=("finding_no", "detected_on"),
    equipment=("equipment_ref",),
    texts=("note",),
)


def findings_rows(spark, d):
    """Orders as findings of five files, to stored rows."""
    o = table(spark, d, "orders").selectExpr(
        "IF(o_orderkey % 10 = 0, ' ', concat(o_orderkey % 3000, IF(o_orderkey % 2 = 0, '.0', ''))) AS `FINDING-NO.`",
        "IF(o_orderkey % 3 = 0, concat(' p-', o_custkey % 400), 'nan') AS `equipment ref`",
        "IF(o_orderkey % 4 = 0, 'Slight  Release', ' Catastrophic ') AS Severity",
        "IF(o_orderkey % 10 = 0, null, date_format(o_orderdate, 'yyyy-MM-dd')) AS Detected",
        "concat('about ', o_orderkey % 50, ' pcs') AS Count",
        "o_orderpriority AS Other",
        "concat('f', o_orderkey % 5) AS source_file",
        "o_orderkey AS seq",
    )
    known = table(spark, d, "customer").selectExpr("concat('P-', c_custkey) AS asset").where("asset like '%1'")
    pid = table(spark, d, "customer").where("c_custkey % 4 = 0").selectExpr("concat('p', c_custkey) AS tag", "c_custkey AS seq")
    rows, _ = intake.findings(o, FINDINGS, "pl 1", known, pid, "b7")
    return rows.select("source_file", "source_record_id", "finding_no", "severity", "severity_raw", "pieces", F.date_format("detected_on", "yyyy-MM-dd").alias("detected_on"), "normalized_asset", "equipment_id", "equipment_uid", "asset_mapped", "confidence", "source_system", "plant_code_id", "upload_batch_id")


FINDINGS_ROWS = """WITH o AS (SELECT o_orderkey AS k, 'f' || o_orderkey % 5 AS file, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE o_orderkey % 3000 || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END END AS no, CASE WHEN o_orderkey % 10 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'P-' || o_custkey % 400 ELSE '' END AS asset, o_custkey % 400 AS c FROM orders),
r AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'row-' || k ELSE k % 3000 || '|' || day END AS own FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY file, own ORDER BY k) AS nth, asset <> '' AND c % 4 = 0 AND c IN (SELECT c_custkey FROM customer) AS drawn FROM r)
SELECT file AS source_file, own || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS source_record_id, no AS finding_no, CASE WHEN k % 4 = 0 THEN 'slight_release' ELSE ' Catastrophic ' END AS severity, CASE WHEN k % 4 = 0 THEN 'Slight  Release' ELSE 'Catastrophic' END AS severity_raw, (k % 50)::DOUBLE AS pieces, day AS detected_on,
 CASE WHEN drawn THEN 'p' || c ELSE asset END AS normalized_asset, CASE WHEN drawn THEN 'p' || c ELSE '' END AS equipment_id, CASE WHEN asset = '' THEN '' ELSE 'eq:' || sha1('PL 1|' || asset) END AS equipment_uid, asset LIKE '%1' AND c IN (SELECT c_custkey FROM customer) AS asset_mapped, CASE WHEN asset = '' THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence, 'ESD' AS source_system, 'pl 1' AS plant_code_id, 'b7' AS upload_batch_id FROM n"""

EXPORT = intake.Export(levels={"plant": 1, "unit": 3, "equipment": 4}, preference=("equipment", "unit"), confidence={"equipment": 1.0, "unit": 0.6})


def _export(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN concat('S\\\\P1\\\\F\\\\U', p_size % 5, '\\\\EQ-', p_partkey % 90) WHEN 1 THEN concat('S\\\\P1\\\\\\\\F\\\\U', p_size % 5) WHEN 2 THEN 'S' ELSE null END AS Parent", "CASE p_partkey % 3 WHEN 0 THEN concat('srv.tag', p_partkey % 200, '.PV') WHEN 1 THEN concat('tag', p_partkey % 200) ELSE ' ' END AS AttributeConfigString", "IF(p_partkey % 6 = 2, '', p_name) AS Name", "IF(p_partkey % 7 = 0, 'Analysis', 'Parameter') AS ObjectType")


def pi_tags(spark, d):
    out = intake.pi_tags(_export(spark, d), EXPORT, 4, name="Name")
    return out.select("p_partkey", "equipment_id", "pi_tag_id", "pi_state", F.substring_index("tag_name", "#", 1).alias("base"), F.contains("tag_name", F.lit("#")).alias("shared"), "hier_plant", "hier_unit", "hier_equipment", "asset_link_level", "asset_link_confidence")


_EXPORT = """WITH e AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['S', 'P1', 'F', 'U' || p_size % 5, 'EQ-' || p_partkey % 90] WHEN 1 THEN ['S', 'P1', 'F', 'U' || p_size % 5] WHEN 2 THEN ['S'] ELSE [] END AS s,
 CASE WHEN p_partkey % 3 < 2 THEN 'tag' || p_partkey % 200 END AS tag, CASE WHEN p_partkey % 3 = 0 THEN 'PV' END AS state, CASE WHEN p_partkey % 6 = 2 THEN '' ELSE p_name END AS name, p_partkey % 7 = 0 AS analysis FROM part)
"""
PI_TAGS = _EXPORT + """, b AS (SELECT *, CASE WHEN state IS NOT NULL THEN tag || '.' || state ELSE coalesce(tag, name) END AS base FROM e)
SELECT p_partkey, CASE WHEN len(s) >= 4 THEN s[-1] END AS equipment_id, tag AS pi_tag_id, state AS pi_state, base, count(*) OVER (PARTITION BY base) > 1 AS shared, coalesce(s[2], '') AS hier_plant, coalesce(s[4], '') AS hier_unit, coalesce(s[5], '') AS hier_equipment, CASE WHEN len(s) = 5 THEN 'equipment' WHEN len(s) = 4 THEN 'unit' ELSE '' END AS asset_link_level, CASE WHEN len(s) = 5 THEN 1.0 WHEN len(s) = 4 THEN 0.6 ELSE 0.0 END::DOUBLE AS asset_link_confidence FROM b"""


def protean_tags(spark, d):
    out = intake.protean_tags(_export(spark, d).drop("AttributeConfigString"), EXPORT, 3, excluded=(" analysis",))
    return out.select("p_partkey", "equipment_id", F.substring_index("tag_name", "#", 1).alias("base"), F.contains("tag_name", F.lit("#")).alias("shared"), "asset_link_level")


PROTEAN_TAGS = _EXPORT + """, b AS (SELECT *, concat_ws('.', nullif(s[4], ''), nullif(name, '')) AS base FROM e WHERE NOT analysis AND (len(s) > 0 OR name <> ''))
SELECT p_partkey, s[4] AS equipment_id, base, count(*) OVER (PARTITION BY base) > 1 AS shared, CASE WHEN len(s) = 5 THEN 'equipment' WHEN len(s) = 4 THEN 'unit' ELSE '' END AS asset_link_level FROM b"""


QUERIES = {
    "page_chunks": (page_chunks, PAGE_CHUNKS),
    "drawing_components": (drawing_components, DRAWING_COMPONENTS),
    "drawing_connections": (drawing_connections, DRAWING_CONNECTIONS),
    "resumed_rows": (resumed_rows, RESUMED),
    "resumed_ledger": (resumed_ledger, RESUMED_LEDGER),
    "document_records": (document_records, DOCUMENT_RECORDS),
    "document_tables": (document_tables, DOCUMENT_TABLES),
    "findings_rows": (findings_rows, FINDINGS_ROWS),
    "pi_tags": (pi_tags, PI_TAGS),
    "protean_tags": (protean_tags, PROTEAN_TAGS),
    "graph_table_edits": (graph_table_edits, GRAPH_TABLE_EDITS),
    "synced_table": (synced_table, SYNCED),
    "missing_links": (missing_links, MISSING_LINKS),
    "graph_upload": (graph_upload, GRAPH_UPLOAD),
    "graph_upload_rejects": (graph_upload_rejects, GRAPH_UPLOAD_REJECTS),
    "series_paths": (series_paths, SERIES_PATHS),
    "log_range": (log_range, LOG_RANGE),
    "copied_columns": (copied_columns, "SELECT s_suppkey, s_name, s_suppkey AS key FROM supplier"),
    "mapped_headers": (mapped_headers, "SELECT c_custkey AS functional_location, c_name AS finding, 'FUNC. LOCATION,Find-ing' AS mapped, 'FLOC,Other' AS unmapped, 'severity' AS missing FROM customer"),
}
