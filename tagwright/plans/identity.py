"""Queries on tags, locations and the ladders that name a row's asset. Inputs that both engines build alike are SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.functions import tags
from tagwright.operators import identity
from tagwright.plans.series import table

TAG = "concat(p_partkey % 900, 'kg', p_size, CASE WHEN p_partkey % 4 = 0 THEN '_TZ07' WHEN p_partkey % 4 = 1 THEN '_00XQ1' WHEN p_partkey % 4 = 2 THEN '-b' ELSE '' END)"
FLOC = "concat('na-', s_nationkey, '.U', s_suppkey % 7, '.V', s_suppkey * 10, CASE s_suppkey % 5 WHEN 0 THEN concat('-101lcv', s_suppkey, 'A') WHEN 1 THEN '-ESD' WHEN 2 THEN '-x-7' WHEN 3 THEN '' ELSE '-99' END)"
FLAT = "concat('B', s_nationkey, '-', substring(s_name, 1, 1), s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE '' END)"
PATH = "concat('site/ ', n_regionkey, '//unit ', n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN '/pump' ELSE '' END, CASE WHEN n_nationkey % 3 = 2 THEN '/motor' ELSE '' END)"
NOTE = "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'Unit 7: ' ELSE '' END, 'leak at ', CASE o_orderkey % 6 WHEN 0 THEN concat('P-', o_custkey) WHEN 1 THEN concat('rev 12 and kg', o_custkey + 100) WHEN 2 THEN 'HC 12 seal' WHEN 3 THEN concat('valve p_', o_custkey, ' and P-', o_custkey) WHEN 4 THEN concat('12-AB-', o_custkey + 1000, '-', 1234) ELSE 'nowhere' END)"
NO_TAG = ", ".join(f"'{w}'" for w in tags.NO_TAGS)
LEAF = "regexp_extract(f, '[^.]*$')"

# the asset of a location, as struct(asset, method)
FROM_FLOC = r"""CASE WHEN f = '' THEN NULL
 WHEN contains(tail, '-') AND length(e) >= 2 AND NOT regexp_matches(e, '^[0-9]+$') AND NOT regexp_matches(e, '^[A-Z]{2,4}$') THEN {'asset': e, 'method': 'floc_tail'}
 WHEN regexp_matches(tail, '^[A-Z]{2,4}$') AND contains(f, '.') THEN {'asset': f, 'method': 'floc_segment'} ELSE {'asset': tail, 'method': 'floc_segment'} END"""
# the first tag-shaped word of a text t
FROM_TEXT = rf"""list_filter(list_transform(flatten([regexp_extract_all(b, '\b\d{{2,4}}-[A-Z]{{1,4}}-\d{{3,5}}-\d{{3,5}}(?:-[A-Z0-9]+)?\b'), regexp_extract_all(b, '\b[A-Z]{{1,4}}-\d{{1,5}}[A-Z]?\b'),
 regexp_extract_all(b, '\b[A-Z]{{1,4}}\d{{2,5}}[A-Z]?\b'), regexp_extract_all(b, '\b[A-Z]{{2,4}}\s\d{{1,4}}[A-Z]?\b')]), lambda x: replace(x, ' ', '-')), lambda x: string_split(x, '-')[1] NOT IN ({NO_TAG}))[1]"""
BODY = "CASE WHEN contains(substring(t, 1, 12), ':') THEN regexp_replace(t, '^[^:]*:', '') ELSE t END"
CANDIDATES = "list_filter(regexp_extract_all(t, '[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*'), lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))"
KEY = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"


def tag_parts(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(TAG).alias("t"))
    m = tags.measurement("t")
    suffix = F.concat(F.lit("-"), F.substring("t", -2, 2))
    return p.select("p_partkey", F.array_join(tags.numeric_parts("t"), ",").alias("numbers"), tags.sibling_suffix("t").alias("sibling"), tags.area_code("t").alias("area"), m["name"].alias("measures"), m["uom"].alias("uom"), tags.sub_equipment(F.upper(suffix)).alias("sub"), tags.without_suffixes(F.concat("t", F.lit(" new")), ["NEW", "HWI"]).alias("plain"))


TAG_PARTS = f"""WITH p AS (SELECT p_partkey, {TAG} AS t FROM part), q AS (SELECT *, upper(t) AS u, regexp_extract(CASE WHEN contains(t, '_') THEN regexp_replace(upper(t), '^[^_]*_', '') ELSE upper(t) END, '[A-Z]{{2}}') AS code FROM p)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')), ',') AS numbers, regexp_replace(u, '^.*[0-9]', '') AS sibling, regexp_extract(t, '^[0-9]+')[1:3] AS area,
 CASE code WHEN 'TZ' THEN 'temperature' END AS measures, CASE code WHEN 'TZ' THEN '°C' END AS uom,
 CASE right(u, 2) WHEN 'G1' THEN 'Gearbox' ELSE 'Sub-component' END AS sub, t AS plain FROM q"""


def floc_parts(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.expr(FLOC).alias("f"), F.expr(FLAT).alias("flat"))
    x = tags.floc("f")
    return s.select("s_suppkey", x["site"].alias("site"), F.size(x["levels"]).cast("long").alias("levels"), x["parent"].alias("parent"), x["item"].alias("item"), tags.physical_tag("flat").alias("physical"), tags.physical_tag("f").alias("physical_deep"), F.array_join(tags.floc_candidates("f"), ",").alias("candidates"))


FLOC_PARTS = f"""WITH s AS (SELECT s_suppkey, {FLOC} AS f, {FLAT} AS flat FROM supplier), l AS (SELECT *, {LEAF} AS leaf, upper({LEAF}) AS u, string_split({LEAF}, '-') AS ps FROM s),
c AS (SELECT *, upper(CASE WHEN len(ps) > 1 THEN regexp_extract(ps[-1], '^[A-Za-z0-9]+') ELSE '' END) AS a, upper(regexp_extract(ps[1], '^[A-Za-z0-9]+')) AS b, upper(CASE WHEN len(ps) > 2 THEN array_to_string(ps[2:], '-') ELSE '' END) AS r FROM l),
i AS (SELECT *, CASE WHEN contains(u, '-') THEN regexp_replace(regexp_replace(u, '^[^-]*-', ''), '[^A-Z0-9]', '', 'g') ELSE regexp_replace(u, '[^A-Z0-9]', '', 'g') END AS item FROM c)
SELECT s_suppkey, 'NA' AS site, 3 AS levels, CASE WHEN contains(u, '-') THEN string_split(u, '-')[1] ELSE '' END AS parent, item,
 regexp_extract(flat, '^[^-]*') || '-S-' || lpad(s_suppkey::VARCHAR, greatest(4, length(s_suppkey::VARCHAR))::INTEGER, '0') || CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE '' END AS physical, item AS physical_deep,
 array_to_string(list_filter([a, CASE WHEN b <> a THEN b ELSE '' END, CASE WHEN r <> a AND r <> b THEN r ELSE '' END], lambda x: x <> ''), ',') AS candidates FROM i"""


def hierarchy_levels(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.expr(PATH).alias("p"))
    parts = tags.hierarchy("p", "/")
    level = tags.deepest_level(parts, {"unit": 2, "equipment": 3, "part": 4}, ["part", "equipment", "unit"], {"part": 0.9, "equipment": 1.0})
    point = tags.point_reference(F.regexp_replace("p", "/+", "."))
    return n.select("n_nationkey", F.array_join(parts, "|").alias("segments"), tags.at_depth(parts, 3).alias("equipment"), level["level"].alias("link_level"), level["confidence"].alias("link_confidence"), point["tag"].alias("point_tag"), point["attribute"].alias("point_attribute"))


HIERARCHY = f"""WITH n AS (SELECT n_nationkey, list_filter(list_transform(string_split({PATH}, '/'), lambda x: trim(x)), lambda x: x <> '') AS s FROM nation)
SELECT n_nationkey, array_to_string(s, '|') AS segments, CASE WHEN len(s) >= 3 THEN s[-1] END AS equipment, CASE len(s) WHEN 5 THEN 'part' WHEN 4 THEN 'equipment' ELSE 'unit' END AS link_level,
 CASE len(s) WHEN 5 THEN 0.9 WHEN 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS link_confidence, s[-2] AS point_tag, s[-1] AS point_attribute FROM n"""


def asset_keys(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("plant/x:"), F.expr(TAG), F.lit("PV2.value")).alias("t"))
    return p.select("p_partkey", tags.asset_part("t", paths=("/", ":"), attributes=(".",)).alias("part"), tags.asset_key("t", aggregates=("AVG",), instruments=("PV",), paths=("/", ":"), attributes=(".",)).alias("key"))


ASSET_KEYS = f"""WITH p AS (SELECT p_partkey, {TAG} || 'PV2' AS part FROM part), q AS (SELECT *, regexp_replace(regexp_extract(upper(part), '^[^_-]*'), 'PV[0-9]*$', '') AS f FROM p)
SELECT p_partkey, part, regexp_extract(f, '[0-9]+[A-Z]+[A-Z0-9]*|[A-Z]+[0-9]+[A-Z0-9]*') AS key FROM q"""


def clean_descriptions(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("concat(CASE p_partkey % 3 WHEN 0 THEN '0042  ' WHEN 1 THEN 'AB12C ' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN upper(concat('hp ', p_name)) ELSE p_name END)").alias("t"))
    return p.select("p_partkey", tags.clean_description("t").alias("description"))


CLEAN = """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper('hp ' || p_name) ELSE p_name END AS t FROM part), q AS (SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS s FROM p)
SELECT p_partkey, CASE WHEN s = upper(s) THEN array_to_string(list_transform(string_split(s, ' '), lambda w: CASE WHEN w IN ('HP', 'LP', 'NG', 'LPG', 'GAS', 'WO', 'ID', 'OD', 'RPM', 'OK') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') ELSE s END AS description FROM q"""


def findings_ladder(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 11 = 0 THEN concat(o_custkey, '.0') ELSE ' ' END").alias("sap_equipment_id"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN concat(' p-', o_custkey) ELSE 'NaN' END").alias("equipment_ref"), F.expr(FLOC.replace("s_suppkey", "o_custkey").replace("s_nationkey", "o_custkey")).alias("f"), F.expr(NOTE).alias("note"))
    o = o.withColumn("f", F.when(F.col("o_orderkey") % 5 == 0, F.col("f")).when(F.col("o_orderkey") % 5 == 1, F.lit("a.b.ESD")))
    return identity.findings(o, ("sap_equipment_id",), ("equipment_ref",), ("f",), ("note",)).select("o_orderkey", "normalized_asset", "asset_match_method", "asset_match_confidence")


FINDINGS_LADDER = f"""WITH o AS (SELECT o_orderkey, o_custkey, upper(CASE o_orderkey % 5 WHEN 0 THEN {FLOC.replace("s_suppkey", "o_custkey").replace("s_nationkey", "o_custkey")} WHEN 1 THEN 'a.b.ESD' ELSE '' END) AS f, upper({NOTE}) AS t FROM orders),
p AS (SELECT *, {LEAF} AS tail, regexp_extract({LEAF}, '[^-]*$') AS e, {BODY} AS b FROM o),
q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN {{'asset': o_custkey::VARCHAR, 'method': 'sap_equipment'}} WHEN o_orderkey % 7 = 0 THEN {{'asset': 'P-' || o_custkey, 'method': 'equipment_tag'}} ELSE {FROM_FLOC} END AS a, {FROM_TEXT} AS w FROM p),
r AS (SELECT o_orderkey, coalesce(a, CASE WHEN w IS NOT NULL THEN {{'asset': w, 'method': 'text_extract'}} END, {{'asset': '', 'method': 'unmatched'}}) AS a FROM q)
SELECT o_orderkey, a.asset AS normalized_asset, a.method AS asset_match_method, CASE a.method WHEN 'sap_equipment' THEN 1.0 WHEN 'equipment_tag' THEN 0.95 WHEN 'floc_tail' THEN 0.85 WHEN 'floc_segment' THEN 0.8 WHEN 'text_extract' THEN 0.6 ELSE 0.0 END::DOUBLE AS asset_match_confidence FROM r"""


def alerts_ladder(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 4 = 0 THEN concat('p ', o_custkey) WHEN o_orderkey % 4 = 1 THEN '  ' END").alias("tag_no"), F.expr(NOTE).alias("note"))
    equipment = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("P-"), "c_custkey").alias("equipment_id"))
    return identity.alerts(o, "o_orderkey", "tag_no", "note", equipment, "equipment_id")


ALERTS_LADDER = f"""WITH e AS (SELECT 'P-' || c_custkey AS equipment_id, 'P' || c_custkey AS k FROM customer WHERE c_custkey % 3 > 0),
o AS (SELECT o_orderkey, o_orderkey % 4 = 0 AS tagged, 'P' || o_custkey AS own, {NOTE} AS t FROM orders),
c AS (SELECT o_orderkey, tagged, own, CASE WHEN tagged THEN [own] ELSE list_transform({CANDIDATES}, lambda x: {KEY.format("x")}) END AS ks FROM o),
h AS (SELECT o_orderkey, arg_min(equipment_id, i) AS equipment_id FROM (SELECT o_orderkey, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM c) JOIN e USING (k) GROUP BY o_orderkey)
SELECT o_orderkey, equipment_id, coalesce(equipment_id, CASE WHEN tagged THEN own END) AS normalized_asset,
 CASE WHEN tagged AND equipment_id IS NOT NULL THEN 'tag_number' WHEN tagged THEN 'tag_number_unmatched' WHEN equipment_id IS NOT NULL THEN 'description' WHEN len(ks) = 0 THEN 'description_no_candidate' ELSE 'description_unmatched' END AS asset_match_method,
 CASE WHEN tagged AND equipment_id IS NOT NULL THEN 1.0 WHEN equipment_id IS NOT NULL THEN 0.8 WHEN NOT tagged AND len(ks) = 0 THEN NULL ELSE 0.0 END::DOUBLE AS asset_match_confidence FROM c LEFT JOIN h USING (o_orderkey)"""


def sap_pid_identity(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 9 = 0 THEN concat(' eq-', s_suppkey) WHEN s_suppkey % 9 = 1 THEN '' ELSE 'none such' END").alias("equnr"), F.expr(FLOC).alias("f"))
    r = table(spark, d, "supplier").select(F.expr("concat('V', s_suppkey * 20)").alias("pid_tag"), F.concat(F.lit("EQ"), "s_suppkey").alias("equipment_id"), "s_suppkey")
    return identity.sap_to_pid(s, "s_suppkey", "equnr", "f", r, ["pid_tag", "equipment_id"], "pid_tag", "s_suppkey")


SAP_PID = """WITH s AS (SELECT s_suppkey, s_suppkey * 10 AS v, s_suppkey % 9 AS m, s_suppkey % 5 AS n FROM supplier),
t AS (SELECT s_suppkey AS k, s_suppkey * 20 AS v FROM supplier)
SELECT s.s_suppkey, CASE WHEN m = 1 THEN '' WHEN m = 0 THEN 'V' || s.s_suppkey * 20 WHEN t.k IS NOT NULL THEN 'V' || t.v ELSE '' END AS pid_asset_tag,
 CASE WHEN m = 1 THEN 'none' WHEN m = 0 THEN 'exact' WHEN t.k IS NOT NULL THEN 'floc' ELSE 'none' END AS asset_match_method,
 CASE WHEN m = 1 THEN 0.0 WHEN m = 0 THEN 1.0 WHEN t.k IS NOT NULL THEN 0.85 ELSE 0.0 END::DOUBLE AS asset_match_confidence FROM s LEFT JOIN t ON s.v = t.v"""


def pid_map_match(spark, d):
    r = table(spark, d, "part").select(F.expr("concat('SITE P-', p_partkey % 500)").alias("asset"), "p_partkey")
    o = table(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('p', c_custkey) END").alias("equipment"))
    return identity.on_diagram(o, "equipment", r, "asset", "p_partkey").drop("equipment")


PID_MAP = """WITH r AS (SELECT DISTINCT p_partkey % 500 AS k FROM part) SELECT c_custkey, r.k IS NOT NULL AS pid_matched, coalesce('SITE P-' || r.k, '') AS pid_asset, CASE WHEN r.k IS NOT NULL THEN 1.0 END::DOUBLE AS pid_confidence
FROM customer LEFT JOIN r ON r.k = c_custkey AND c_custkey % 10 <> 0"""


def crosswalk(spark, d):
    sap = table(spark, d, "part").select(F.expr("CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE concat('10', p_partkey) END").alias("sap_id"), F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('pump ', p_size) WHEN 1 THEN concat('T', p_size) WHEN 2 THEN concat('site xpump ', p_size, 'a') ELSE p_name END").alias("normalized_asset"))
    pid = table(spark, d, "part").where("p_partkey <= 60").select(F.expr("CASE WHEN p_partkey % 8 = 0 THEN '' ELSE concat('t', p_partkey) END").alias("tag"), F.expr("concat('Pump ', p_partkey)").alias("normalized_asset"), F.col("p_partkey").alias("seq"))
    return identity.crosswalk(sap, pid, "p1")


CROSSWALK = """WITH sap AS (SELECT '10' || p_partkey AS sap_id, upper(CASE p_partkey % 4 WHEN 0 THEN concat('pump ', p_size) WHEN 1 THEN concat('T', p_size) WHEN 2 THEN concat('site xpump ', p_size, 'a') ELSE p_name END) AS a FROM part WHERE p_partkey % 50 <> 0),
pid AS (SELECT CASE WHEN p_partkey % 8 = 0 THEN '' ELSE concat('T', p_partkey) END AS tag, CASE WHEN p_partkey % 8 = 0 THEN concat('PUMP ', p_partkey) ELSE concat('t', p_partkey) END AS name, concat('PUMP ', p_partkey) AS norm, p_partkey AS seq FROM part WHERE p_partkey <= 60),
c AS (SELECT sap_id, a, n.name AS by_norm, t.name AS by_tag, (SELECT arg_min(p.name, p.seq) FROM pid p WHERE contains(a, p.norm)) AS inside FROM sap LEFT JOIN pid n ON a = n.norm LEFT JOIN pid t ON a = t.tag AND t.tag <> '')
SELECT 'p1' AS plant_code_id, coalesce(by_norm, by_tag, inside) AS pid_tag, sap_id AS sap_equipment_id, a AS normalized_asset, CASE WHEN by_norm IS NOT NULL THEN 'exact_normalized_asset' WHEN by_tag IS NOT NULL THEN 'exact_pid_tag' ELSE 'contains_pid_tag' END AS match_method,
 CASE WHEN by_norm IS NULL AND by_tag IS NULL THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM c WHERE coalesce(by_norm, by_tag, inside) IS NOT NULL"""


def asset_link(spark, d):
    ts = table(spark, d, "part").select(F.expr(TAG).alias("ts_tag"))
    comp = table(spark, d, "part").where("p_partkey % 6 = 0").select(F.expr("concat(p_partkey % 900, 'KG', CASE WHEN p_partkey % 12 = 0 THEN p_size ELSE p_size % 5 END)").alias("tag"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'Equipment' ELSE 'Line' END").alias("type"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE '' END").alias("description"), F.col("p_partkey").alias("seq"))
    return identity.asset_link(ts, "ts_tag", comp)


ASSET_LINK = f"""WITH c AS (SELECT concat(p_partkey % 900, 'KG', CASE WHEN p_partkey % 12 = 0 THEN p_size ELSE p_size % 5 END) AS ct, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS other, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE '' END AS n, p_partkey AS seq FROM part WHERE p_partkey % 6 = 0),
r AS (SELECT DISTINCT upper({TAG}) AS tag FROM part), b AS (SELECT tag, string_split(tag, '_')[1] AS base FROM r),
j AS (SELECT tag, base, CASE WHEN ct = tag THEN 1 WHEN ct = base THEN 2 WHEN starts_with(ct, base) OR starts_with(base, ct) THEN 3 ELSE 4 END AS tier, other, length(ct) AS size, seq, CASE WHEN n = '' THEN ct ELSE n END AS name
 FROM b JOIN c ON ct = tag OR starts_with(ct, base) OR starts_with(base, ct) OR (regexp_matches(base, '^[0-9]{{3}}') AND ct[1:3] = base[1:3])),
k AS (SELECT tag, arg_min({{'name': name, 'tier': tier}}, (tier, CASE WHEN tier < 3 THEN 0 ELSE other END, CASE WHEN tier < 3 THEN 0 ELSE size END, seq)) AS h FROM j GROUP BY tag)
SELECT b.tag, coalesce(h.name, base) AS asset, CASE h.tier WHEN 1 THEN 'exact_tag' WHEN 2 THEN 'exact_base' WHEN 3 THEN 'prefix_contains' WHEN 4 THEN 'family_3digit' ELSE 'fallback_base_tag' END AS method,
 CASE h.tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.8 WHEN 4 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM b LEFT JOIN k USING (tag)"""


QUERIES = {
    "tag_parts": (tag_parts, TAG_PARTS),
    "floc_parts": (floc_parts, FLOC_PARTS),
    "hierarchy_levels": (hierarchy_levels, HIERARCHY),
    "asset_keys": (asset_keys, ASSET_KEYS),
    "clean_descriptions": (clean_descriptions, CLEAN),
    "findings_ladder": (findings_ladder, FINDINGS_LADDER),
    "alerts_ladder": (alerts_ladder, ALERTS_LADDER),
    "sap_pid_identity": (sap_pid_identity, SAP_PID),
    "pid_map_match": (pid_map_match, PID_MAP),
    "crosswalk": (crosswalk, CROSSWALK),
    "asset_link": (asset_link, ASSET_LINK),
}
