"""Uploads to stored rows against plain loops."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tagwright.operators import intake, resume


def part(v):
    t = "" if v is None else str(v).strip()
    if t.lower() in ("nan", "nat", "none", "null"):
        return ""
    if re.fullmatch(r"\d+\.0+", t):
        return t.split(".")[0]
    return t[:10] if len(t) == 19 and t[4] == "-" and t.endswith("00:00:00") else t


def bounded(k):
    return k if len(k) <= 180 else f"{k[:167]}~{hashlib.sha1(k.encode()).hexdigest()[:12]}"


def test_record_ids_are_those_of_a_loop(spark):
    r = random.Random(15)
    rows = [(r.choice("ab"), k, r.choice(["1", "1.0", " 2 ", None, "nan", "é" * 200, "2024-01-01 00:00:00", "2024-01-01 10:00:00"]), r.choice([None, "x", ""])) for k in range(1, 200)]
    got = {x.seq: x.source_record_id for x in intake.record_ids(spark.createDataFrame(rows, "file string, seq int, a string, b string"), ["b", "a", "missing"], "file", "seq").collect()}
    want, seen = {}, {}
    for file, seq, a, b in rows:
        key = bounded("|".join([part(b), part(a), ""]).strip("|")) or f"row-{seq}"
        seen[file, key] = seen.get((file, key), 0) + 1
        want[seq] = key if seen[file, key] == 1 else bounded(f"{key}#{seen[file, key]}")
    assert got == want and len({(f, got[s]) for f, s, _, _ in rows}) == len(rows)


def test_findings_need_their_columns(spark):
    spec = intake.Findings("x", {"no": ["Number"], "asset": ["Tag"]}, required=("no",), natural_key=("no",), equipment=("asset",))
    known = spark.createDataFrame([(" p-1 ",), (None,)], "asset string")
    df = spark.createDataFrame([("1", "p-1", "f", 1), ("1", None, "f", 2)], "number string, tag string, source_file string, seq int")
    rows, report = intake.findings(df, spec, "P", known)
    assert report == {"mapped": ["number", "tag"], "unmapped": [], "missing": []}
    assert sorted((x.source_record_id, x.normalized_asset, x.asset_mapped, x.confidence, x.source_system) for x in rows.collect()) == [("1", "P-1", True, 0.95, "X"), ("1#2", "", False, 0.0, "X")]
    with pytest.raises(ValueError, match="missing required"):
        intake.findings(df.drop("number"), spec, "P", known)
    assert intake.findings(df.where("false"), spec, "P", known)[0].count() == 0


def test_exports(spark):
    spec = intake.Export(levels={"unit": 1}, preference=("unit",), confidence={"unit": 0.5})
    pi = spark.createDataFrame([("a\\b\\EQ", "x.t1.PV", "n"), ("a\\b\\EQ", "x.t1.PV", "n2"), (None, None, " named "), ("a", "t2", None)], "Parent string, AttributeConfigString string, Name string")
    got = sorted(((x.equipment_id, x.pi_tag_id, x.pi_state, x.tag_name.split("#")[0], "#" in x.tag_name, x.hier_unit) for x in intake.pi_tags(pi, spec, 3, name="Name").collect()), key=str)
    assert got == sorted([("EQ", "t1", "PV", "t1.PV", True, "b"), ("EQ", "t1", "PV", "t1.PV", True, "b"), (None, None, None, "named", False, ""), (None, "t2", None, "t2", False, "")], key=str)
    protean = spark.createDataFrame([("a\\EQ1\\c", "p", "Parameter"), ("a", "q", "x"), ("", None, "x"), ("a\\EQ1", "p", "ANALYSIS ")], "Parent string, Name string, ObjectType string")
    got = {(x.equipment_id, x.tag_name) for x in intake.protean_tags(protean, spec, 1, excluded=("Analysis",)).collect()}
    assert got == {("EQ1", "EQ1.p"), (None, "q")}


def sha(*parts):
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:12]


def test_rows_of_documents(spark):
    entries = [("my doc.v1.pdf", "rca", 3, 0, 1, 2, {"A": " ", "B": None}), ("my doc.v1.pdf", "rca", 3, 1, 1, 2, {"Tag": "NaN", "B": " x "}), ("my doc.v1.pdf", "rca", 3, 2, 1, 2, {"Tag No.": "T1", "Tag": "T2"}), ("my doc.v1.pdf", "rca", 4, 0, 0, 0, None)]
    df = spark.createDataFrame(entries, "file string, document_type string, chunk int, position int, page_start int, page_end int, values map<string,string>")
    got = {x.position: x for x in resume.record_rows(df).collect()}
    assert sorted(got) == [0, 1] and got[0].extracted_entities == "B: x" and got[0].equipment_tag == "" and got[1].equipment_tag == "T1" and got[0].source_pages == "1-2"
    assert got[0].document_id == f"DOC-my_doc.v1-{sha('my doc.v1.pdf', 'rca')}".upper() and got[1].record_id == f"REC-my_doc.v1-{sha('my doc.v1.pdf', 'rca', 'row3.1')}".upper()
    cells = [("t.csv", "log", None, 0, 5, {"a": "1", "Tag": "T"}), ("t.csv", "log", "S" * 50, 1, 6, {"b": "none"}), ("t.csv", "log", "S", 1, 7, None)]
    df = spark.createDataFrame(cells, "file string, document_type string, sheet string, ordinal int, idx int, values map<string,string>").withColumn("equipment_tag", F.lit("clash"))
    got = {x.record_id: (x.equipment_tag, x.extracted_entities, x.chunk, x.source_pages) for x in resume.tabular_rows(df, ["b", "a"]).collect()}
    rid = lambda row: f"REC-t-{sha('t.csv', 'log', row)}".upper()
    assert got == {rid("row5"): ("T", "a: 1", 0, ""), rid("row" + "S" * 50 + "!6"): ("", "", 1, "S" * 40), rid("rowS!7"): ("", "", 1, "S")}
