"""Relationships by definition and the series ladder against plain row loops."""

import hashlib
import random
import re
from difflib import SequenceMatcher

from tagwright.operators import ladder, relations
from tagwright.operators.relations import Definition, Entity

ENTITIES = {
    "equipment": Entity(("plant_code_id", "normalized_asset"), "equipment_uid", {"normalized_asset": {"sap_wo": "asset"}}),
    "work_order": Entity(("plant_code_id", "wo_number"), "wo_uid"),
    "document": Entity(("document_id",), "document_uid"),
    "vendor": Entity(("vendor_code",), "vendor_uid"),
}
DEFINITIONS = (
    Definition("wo_to_equipment", "sap_wo", "EXECUTED_ON", "work_order", "equipment", ("plant_code_id", "wo_number", "asset")),
    Definition("equipment_document", "documents", "HAS_DOCUMENT", "equipment", "document", ("plant_code_id", "normalized_asset", "document_id", "page")),
    Definition("loose", "documents", "NAMES", "document", "equipment"),
    Definition("no_source", "sap_po", "X", "document", "equipment"),
    Definition("no_table", "documents", "X", "vendor", "equipment"),
)


def norm(v):
    v = "" if v is None else str(v).strip()
    return "" if v.lower() in ("nan", "none", "nat") else v


def plain(sources, tables):
    out, sha = set(), lambda *x: hashlib.sha1("|".join(x).encode()).hexdigest()
    ids = {n: {tuple(str(r[k]).strip() for k in ENTITIES[n].keys): r[ENTITIES[n].uid] for r in rows if r[ENTITIES[n].uid] is not None and all(r[k] is not None and str(r[k]).strip() for k in ENTITIES[n].keys)} for n, rows in tables.items()}
    for d in DEFINITIONS:
        if d.source not in sources or d.parent not in tables or d.child not in tables:
            continue
        seen = set()
        for r in sources[d.source]:
            mark = tuple(None if r[c] is None else r[c].strip() for c in d.distinct if c in r)
            if mark and mark in seen:
                continue
            seen.add(mark)
            key = lambda e, k: norm(r.get(k if k in r else ENTITIES[e].columns.get(k, {}).get(d.source)))  # noqa: E731, B023
            a, b = (tuple(key(e, k) for k in ENTITIES[e].keys) for e in (d.parent, d.child))
            plant = norm(r["plant_code_id"]) if "plant_code_id" in r else a[0]
            if not all(a + b) or not plant or a not in ids[d.parent] or b not in ids[d.child]:
                continue
            p, c = ids[d.parent][a], ids[d.child][b]
            record = norm(r.get("source_record_id")) or f"{d.source}_{d.name}:" + sha(*([norm(r.get(x)) for x in d.distinct] or [plant, d.name, *a, *b]))
            out.add(("rel:" + sha(plant, d.rel_type, p, c), plant, p, c, d.rel_type, norm(r["source_system"]) if "source_system" in r else "SAP", record, float(r.get("confidence", 0.8))))
    return out


def test_relationships_are_those_of_a_row_loop(spark):
    r = random.Random(12)
    some = lambda *x: r.choice(x)
    sources = {
        "sap_wo": [{"plant_code_id": some("P1", " P1", "P2", "", None), "wo_number": some("w1", "w2 ", "nan"), "asset": some("a1", "a2", None)} for _ in range(60)],
        "documents": [{"plant_code_id": some("P1", "P2"), "normalized_asset": some("a1", "a2", "a9", " "), "document_id": some("d1", " d2", "d3"), "source_system": some("dms", "None"), "source_record_id": some("", f"r{k}", None), "confidence": some(0.5, 1.0)} for k in range(60)],
    }
    tables = {
        "equipment": [{"plant_code_id": p, "normalized_asset": a, "equipment_uid": u} for p, a, u in (("P1", "a1", "e1"), ("P1", "a2 ", "e2"), ("P2", "a1", "e3"), ("P2", "a1", "e4"), ("P2", "", "e5"), ("P2", "a2", None))],
        "work_order": [{"plant_code_id": "P1", "wo_number": "w1", "wo_uid": "x1"}, {"plant_code_id": "P2", "wo_number": "w2", "wo_uid": "x2"}],
        "document": [{"document_id": "d1", "document_uid": "y1"}, {"document_id": "d2", "document_uid": "y2"}],
    }
    kinds = {"confidence": "double"}
    frame = lambda rows: spark.createDataFrame([(*x.values(), k) for k, x in enumerate(rows)], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in rows[0]) + ", seq int")
    got = relations.relationships({k: frame(v) for k, v in sources.items()}, ENTITIES, {k: frame(v) for k, v in tables.items()}, DEFINITIONS)
    want = plain(sources, tables)
    assert {tuple(x) for x in got.collect()} == want and len({x[4] for x in want}) == 3
    assert relations.relationships({}, ENTITIES, {}) is None
    assert len(relations.DEFINITIONS) == 15 and len({d.name for d in relations.DEFINITIONS}) == 15


def plain_ladder(rows, reference, policy):
    match = lambda v: re.sub("[^A-Z0-9]+", "", v.strip().upper())
    spaced = lambda v: re.sub("[^A-Z0-9]+", " ", v.upper()).strip()
    numbers = lambda v: [n.lstrip("0") or "0" for n in re.findall(r"\d+", v)]
    tail = lambda v: re.sub(r"^.*\d", "", v) if re.search(r"\d", v) else ""
    same = lambda a, b: numbers(a) == numbers(b) and tail(a) == tail(b)
    ref = []
    for r in reference:
        eq = next((norm(r[c]) for c in policy.equipment_id_columns if r.get(c) and r[c].strip()), "")
        for c in policy.candidate_columns:
            name = (r.get(c) or "").strip()
            if name and spaced(name):
                ref.append((match(name), (r.get(policy.identity_column) or "").strip() or name, eq, c))

    def lookup(v):
        hits = [x for x in ref if match(v) and x[0] == match(v)]
        hits = [x for x in hits if x[3] == policy.identity_column] or hits
        return hits[0][1:3] if hits else ("", "")

    def nearest(key):
        if exact := [x for x in ref if x[0] == key]:
            return exact[0][2], 1.0, "exact"
        if len(key) < policy.least_key:
            return "", 0.0, ""
        if inside := [(abs(len(x[0]) - len(key)), x[0], i) for i, x in enumerate(ref) if len(x[0]) >= policy.least_key and (x[0] in key or key in x[0]) and same(key, x[0])]:
            return ref[min(inside)[2]][2], 0.92, "contains"
        near = [x for x in ref if x[0].startswith(key[:3])] or ref
        best = max(((SequenceMatcher(None, key, x[0]).ratio(), -i, x[2]) for i, x in enumerate(near) if same(key, x[0])), default=(0, 0, ""))
        return (best[2], best[0], "fuzzy") if best[0] >= 0.84 else ("", 0.0, "")

    out = {}
    for row, tag, key, asset, eq in rows:
        how = "source_asset" if asset else "tag_pattern" if key else "tag_name_fallback"
        asset = asset or key or tag
        score = 0.5 if how == "tag_name_fallback" else 0.9
        if ref:
            identity, found = lookup(eq or key or tag)
            if found:
                how, score, asset = ("source_verified_against_pid" if found == eq else "source_relinked_to_pid") if eq else "pid_match_key", 1.0, identity or asset
                eq = found
            elif eq:
                how, score = "source_only_no_pid_match", 0.4
            else:
                found, score, kind = nearest(spaced(key or tag))
                if found and score >= policy.fuzzy_threshold:
                    eq, how = found, f"pid_{kind}"
                else:
                    how, score = f"{how}_no_pid_match", 0.4
        out[row] = (asset, eq, how, round(score, 9))
    return out


def test_the_whole_ladder_is_that_of_a_row_loop(spark):
    r = random.Random(13)
    some = lambda *x: r.choice(x)
    name = lambda: some("K-2410A", "P-1310A", "P-1310C", "TURBINEXPUMP-77", "LUBEOILPUMP 12", "K2410A", "", None, "V-" + str(r.randrange(300)), "AREA-PUMPXX101")
    reference = [{"normalized_asset": name(), "equipment_tag": name(), "equipment_id": some(None, name()), "floc": name()} for _ in range(40)]
    word = lambda: some("K2410A", "P1310", "TURBINEYPUMP77", "LUBEOILPUNP12", "V" + str(r.randrange(300)), "PUMPXX101", "plain", "X9", "")
    rows = [(k, some("", "hist!", "a/b\\") + word() + some("", ".Act_Flow", "_FZ1", "#2", "-x"), some("", None, "ASSET1"), some("", "", None, "K 2410 A", "ZZ-1", name())) for k in range(250)]
    schema = "normalized_asset string, equipment_tag string, equipment_id string, floc string"
    ref = spark.createDataFrame([(*x.values(), k) for k, x in enumerate(reference)], schema + ", seq int")
    df = spark.createDataFrame([(*x, "kept") for x in rows], "row int, tag_name string, normalized_asset string, equipment_id string, note string")
    for policy, own, table in ((ladder.Policy(), reference, ref), (ladder.Policy(fuzzy_threshold=0.93), reference, ref), (ladder.Policy(), [], ref.where("false"))):
        got = ladder.resolved(df, "row", table, policy).collect()
        keys = {x.row: x.asset_match_key for x in got}
        want = plain_ladder([(k, tag, keys[k], (a or "").strip(), (e or "").strip()) for k, tag, a, e in rows], own, policy)
        assert {x.row: (x.normalized_asset, x.equipment_id, x.asset_match_method, round(x.asset_match_confidence, 9)) for x in got} == want
        methods = {m for _, _, m, _ in want.values()}
        assert not own or policy.fuzzy_threshold > 0.9 or {"pid_fuzzy", "pid_contains", "pid_match_key", "source_relinked_to_pid", "source_only_no_pid_match"} <= methods
    assert all(x.note == "kept" for x in got)


def test_the_fixture_of_relinking(spark):
    ref = spark.createDataFrame([("K-2410A", 0), ("P-1310A", 1), ("P-1310C", 2)], "equipment_tag string, seq int")
    ref = ref.selectExpr("equipment_tag", "equipment_tag AS equipment_id", "replace(equipment_tag, '-', '') AS normalized_asset", "seq")
    df = spark.createDataFrame([(1, "K2410A.HHPC_Act_Flow", "K2410A"), (2, "K-2410A.Flow", "K-2410A"), (3, "G7510.C1", "G7510")], "row int, tag_name string, equipment_id string")
    got = {x.row: (x.equipment_id, x.asset_match_method, x.asset_match_confidence) for x in ladder.resolved(df, "row", ref).collect()}
    assert got == {1: ("K-2410A", "source_relinked_to_pid", 1.0), 2: ("K-2410A", "source_verified_against_pid", 1.0), 3: ("G7510", "source_only_no_pid_match", 0.4)}


def test_foreign_keys_at_once(spark):
    tables = {"a": spark.createDataFrame([("1", "x"), ("2 ", None), ("nan", "y"), ("3", "z")], "k string, m string"), "b": spark.createDataFrame([("1",), ("2",)], "k string")}
    got = {(x.column, x.parent): (x.referring, x.unresolved, x.unresolved_pct, x.status) for x in relations.unresolved(tables, (("a", "k", "b", "k"), ("a", "m", "b", "k"), ("a", "q", "b", "k"), ("a", "k", "c", "k"))).collect()}
    assert got == {("k", "b"): (3, 1, 33.33, "PASS"), ("m", "b"): (3, 3, 100.0, "WARN"), ("q", "b"): (0, 0, 0.0, "SKIPPED"), ("k", "c"): (0, 0, 0.0, "SKIPPED")}


def test_rows_told_apart_by_their_keys_are_not_made_distinct(spark):
    def related(orders):
        po = spark.createDataFrame([(k, "1", v, "P", n) for n, (k, v) in enumerate(orders)], "po_number string, po_item string, vendor_code string, plant_code_id string, seq int")
        tables = {
            "purchase_order": spark.createDataFrame([("a", "1", "A", 0), ("a|1", "1", "A", 1)], "po_number string, po_item string, uid string, seq int"),
            "vendor": spark.createDataFrame([("v", "V", 0), ("1|v", "V", 1)], "vendor_code string, uid string, seq int"),
        }
        return relations.relationships({"sap_po": po}, {"purchase_order": relations.Entity(("po_number", "po_item"), "uid"), "vendor": relations.Entity(("vendor_code",), "uid")}, tables)

    plain = related([("a", "v"), (" a", "v"), ("a", "w")])
    assert "Aggregate [relationship_uid" not in plain._jdf.queryExecution().optimizedPlan().toString() and plain.count() == 1
    assert related([("a", "1|v"), ("a|1", "v")]).count() == 1  # a|1|1|v twice, between the same ends
