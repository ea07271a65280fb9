"""Page packing, drawings, resumed runs, edits, uploads and path lookups against plain versions."""

import json
import random
import re

from pyspark.sql import functions as F

from tagwright.functions import drawings, pages
from tagwright.operators import resume, sync
from tagwright.plans import catalog
from tests.conftest import SMALL


def plain_packed(texts, limit, overlap):
    out, held, first = [], [], 1
    size = 0

    def close(last):
        nonlocal held, size
        if held:
            out.append(("\n".join(held), first, last))
        held, size = [], 0

    for no, page in enumerate(texts or [], 1):
        page = (page or "").strip()
        if not page:
            continue
        if len(page) > limit:
            close(no - 1)
            out.extend((page[a : a + limit], no, no) for a in range(0, len(page), max(1, limit - overlap)))
            first = no + 1
            continue
        if held and size + len(page) > limit:
            close(no - 1)
        if not held:
            first = no
        held.append(page)
        size += len(page) + 1
    close(len(texts or []))
    return out


def test_pages_are_packed_as_by_a_loop(spark):
    r = random.Random(2)
    page = lambda: r.choice([None, "", "  ", "x" * r.randrange(1, 12), " a\tb ", "é" * r.randrange(20, 70), " wide ", "y" * 20, "z" * 21])
    docs = [(k, [page() for _ in range(r.randrange(14))]) for k in range(300)] + [(900, None), (901, []), (902, ["w" * 3000, None, "tail"])]
    df = spark.createDataFrame(docs, "k int, pages array<string>")
    for limit, overlap in ((20, 5), (20, 0), (7, 9)):
        got = {x.k: [tuple(c) for c in x.c] for x in df.select("k", pages.packed("pages", limit, overlap).alias("c")).collect()}
        assert got == {k: plain_packed(p, limit, overlap) for k, p in docs}
    labels = spark.createDataFrame([(0, 0), (3, 3), (3, 5)], "a int, b int").select(pages.pages_label("a", "b").alias("p")).collect()
    assert [x.p for x in labels] == ["", "3", "3-5"]


def test_fixture_of_ten_pages(spark):
    ten = spark.createDataFrame([(["p" * 100] * 10,)], "pages array<string>")
    spans = lambda limit: [(c.page_start, c.page_end) for c in ten.select(pages.packed("pages", limit, 50).alias("c")).first().c]
    assert spans(2000) == [(1, 10)] and spans(1000) == [(1, 9), (10, 10)]


def plain_rows(text, begin, end):
    lines = text.splitlines()
    plain = [x.replace("*", "").replace("-", "").replace("|", "").lower() for x in lines]
    start = next((k for k, x in enumerate(plain) if begin in x), None)
    if start is None:
        return []
    stop = next((k for k in range(start + 1, len(lines)) if end and end in plain[k]), len(lines))
    out = []
    for line in lines[start + 1 : stop]:
        cells = [c for c in (c.strip().strip("*") for c in line.split("|")) if c]
        if "|" in line and line.replace("-", "").replace("|", "").replace(" ", "") and cells:
            if not any(c.lower() in drawings.HEADER_WORDS for c in cells) and not all(set(c) == {"-"} for c in cells):
                out.append(cells)
    return out


def plain_components(text):
    rows = [tuple((r + ["", "", ""])[:4]) for r in plain_rows(text, "components", "connections")]
    if rows:
        return rows
    found = re.search(r"\[\s*\{.*?\}\s*\]", text, re.DOTALL)
    try:
        items = json.loads(found.group()) if found else []
    except ValueError:
        return []
    out = []
    for item in items:
        label = item.get("label", "").strip().replace("\n", " / ")
        if label:
            kind = next((name for name, codes in drawings.KINDS if any(c in label.upper() for c in codes)), "Unknown")
            out.append((label, kind, "", str(item.get("box_2d", item.get("point", "")))))
    return out


def plain_connections(text):
    rows = [tuple(r[:2]) for r in plain_rows(text, "connections", None) if len(r) > 1]
    if rows:
        return rows
    out = []
    for line in text.splitlines():
        line = line.strip()
        arrow = next((a for a in drawings.ARROWS if a in line), None)
        if arrow:
            a, b = line.split(arrow, 1)
            a, b = a.strip().lstrip("-• *"), b.strip().rstrip(".")
            if a and b:
                out.append((a, b))
    return out


def test_drawings_are_read_as_by_a_plain_parser(spark):
    r = random.Random(3)
    bits = ["--- COMPONENTS ---", "**Connections**", "| Tag | Type |", "|---|---|", "| P-1 | Pump | big | [1, 2] |", "| **V-2** | Valve", "V-3|Valve||", "plain", "", " | | ", "A -> B.", "- X → Y", "• Q→R -> S", "->", "a |", "--|--", "| - | x |", '[{"label": "FV-1", "box_2d": [1, 2, 3]},', '{"label": "MH\\nx", "point": "p"}, {"box_2d": [4]}]', '[{"label": ""}]', "[{broken}]", "| *bbox* | 1 |"]
    texts = ["\n".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(500)] + ["\r\n".join(bits), "\r".join(bits[:9])]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").select("k", drawings.components("t").alias("a"), drawings.connections("t").alias("b")).collect()
    for x in rows:
        text = texts[x.k] if x.k < len(texts) else ""
        assert [tuple(c) for c in x.a] == plain_components(text), text
        assert [tuple(c) for c in x.b] == plain_connections(text), text
    numbers = ["--- DRAWING NUMBER ---\n  N/A\nAB-123-X", "x\n--- DRAWING NUMBER ---\n\n D 1 \n", "no-number", None, "see PID-0001."]
    got = spark.createDataFrame([(t,) for t in numbers], "t string").select(drawings.drawing_number("t").alias("n")).collect()
    assert [x.n for x in got] == ["AB-123-X", "D 1", "Unknown", "Unknown", "PID-0001"]


def test_only_lost_chunks_are_done_again(spark):
    chunks = spark.createDataFrame([("a", k, f"a{k}") for k in range(4)] + [("b", k, f"b{k}") for k in range(3)] + [("c", 0, "c0"), ("d", 0, "d0")], "file string, chunk long, text string")
    ledger = spark.createDataFrame([("a", 4, [1, 3]), ("b", 2, [0]), ("c", 1, []), ("gone", 2, [1])], "file string, n_chunks long, failed array<long>")
    todo = resume.to_do(chunks, ledger)
    assert sorted(x.text for x in todo.collect()) == ["a1", "a3", "b0", "b1", "b2", "d0"] and todo.columns == chunks.columns
    old = spark.createDataFrame([("a", 0, "old"), ("a", 2, "old"), ("b", 1, "old"), ("c", 0, "old"), ("gone", 0, "old")], "file string, chunk long, text string")
    done = todo.withColumn("ok", F.col("text") != "a3")
    rows = resume.merged(old, done.where("ok").drop("ok"), todo, chunks, ledger)
    assert sorted((x.file, x.chunk, x.text) for x in rows.collect()) == [("a", 0, "old"), ("a", 1, "a1"), ("a", 2, "old"), ("b", 0, "b0"), ("b", 1, "b1"), ("b", 2, "b2"), ("c", 0, "old"), ("d", 0, "d0"), ("gone", 0, "old")]
    after = resume.new_ledger(chunks, done, ledger)
    assert {x.file: (x.n_chunks, x.failed) for x in after.collect()} == {"a": (4, [3]), "b": (3, []), "c": (1, []), "d": (1, []), "gone": (2, [1])}
    assert [x.text for x in resume.to_do(chunks, after).collect()] == ["a3"]


def test_a_cell_that_two_nodes_edit_takes_the_later(spark):
    keys, columns = {"t": "uid", "u": "other"}, {"t": ["uid", "name", "size"], "u": ["other", "uid", "name"]}
    schema = "node_id string, label string, properties map<string,string>, lineage map<string,string>"
    by = {"name": "ui_update"}
    nodes = spark.createDataFrame([("1#t", "L", {"name": "a"}, by), ("2#t", "L", {"name": "b", "x": "y"}, {"x": "ui_update"}), ("3", "L", {"name": "c"}, by), ("4#nowhere", "L", {"name": "d"}, by), ("5#t", "M", {"name": "e"}, by), ("6#t", "L", {"name": None, "size": "7", "uid": "6"}, {"source": "ui_update"}), ("7#t", "L", {"name": "z"}, None), ("8#t", "L", None, by)], schema)
    edits = sync.table_edits(nodes, keys, columns, {"L": ["t", "u"]}, {})
    assert sorted(map(tuple, edits.collect())) == [("t", "uid", "1", "name", "a"), ("t", "uid", "6", "size", "7"), ("u", "uid", "1", "name", "a")]
    same = spark.createDataFrame([("1#t", "L", {"p": "a"}, {"p": "ui_update"}), ("1#t", "L", {"q": "b"}, {"q": "ui_update"})], schema)
    assert sync.table_edits(same, keys, columns, {"L": ["t"]}, {("L", "p"): "name", ("L", "q"): "size"}).count() == 2
    df = spark.createDataFrame([(1, "old", 3), (6, "old", None), (9, "old", 1)], "uid int, name string, size int")
    assert sorted(map(tuple, sync.with_edits(df, edits, "t").collect())) == [(1, "a", 3), (6, "old", 7), (9, "old", 1)]
    assert sync.with_edits(df, edits.where("false"), "t").collect() == df.collect()


def test_uploads_name_their_nodes(spark):
    props = "properties map<string,string>"
    nodes = spark.createDataFrame([(3, "Pump", " p1 ", {"k": "1"}), (4, "", "p2", None), (5, "Pump", "p1", {"k": "2"}), (6, "Tank", "t1", None)], f"row int, label string, name string, {props}")
    edges = spark.createDataFrame([(3, "FEEDS", "p1", "t1", None), (4, " ", None, "", {"a": " "}), (5, "FEEDS", "p1", "", None), (6, None, None, None, {"a": "x"}), (7, "FEEDS", "nobody", "no one", None), (8, "FEEDS", "old", "nobody", None), (9, "FEEDS", "old", "p1", {"w": "1"})], f"row int, rel_type string, from_name string, to_name string, {props}")
    stored = spark.createDataFrame([("s2", "old"), ("s1", "old"), ("s3", "p1")], "node_id string, name string")
    made, linked, rejects = sync.upload("b", nodes, edges, stored)
    ids = {x.properties["k"]: x.node_id for x in made.where("name = 'p1'").collect()}
    t1 = made.where("name = 't1'").first().node_id
    assert {(x.from_node_id, x.to_node_id) for x in linked.collect()} == {(ids["2"], t1), ("s1", ids["2"])}
    assert sorted((x.sheet, x.row, x.reason.split(" ")[0]) for x in rejects.collect()) == [("node", 4, "label"), ("node", 5, "duplicate"), ("relationship", 5, "rel_type,"), ("relationship", 6, "rel_type,"), ("relationship", 7, "no"), ("relationship", 8, "no")]
    assert {x.row: x.reason for x in rejects.where("row > 6").collect()} == {7: "no node is named nobody", 8: "no node is named nobody"}
    again = sync.upload("b", nodes, edges, stored)[0]
    assert {x.node_id for x in again.collect()} == {x.node_id for x in made.collect()}


def test_paths_by_their_ends(spark):
    paths = ["root.a.x", "root.b.x", "root.b.y.x", "root.c.T_1_b", "root.c.id7", "root.y"]
    tags = ["x", "y.x", "root.any", "T.1 b", "named", "blank", "none", "y", "root", "b.y.x", "c", None]
    ids = [("named", "id7"), ("blank", " "), ("x", "id7")]
    got = sync.resolved_paths(spark.createDataFrame([(t,) for t in tags], "tag string"), spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, seq int"), spark.createDataFrame(ids, "tag string, series_id string"))

    def plain(tag):
        if tag is None or tag.startswith("root."):
            return tag
        other = next((i for t, i in ids if t == tag and i.strip()), None) or re.sub("[^a-zA-Z0-9_]", "", re.sub(r"[.\s\-/]", "_", tag))
        return next((p for name in (tag, other) for p in paths if p.endswith("." + name)), None)

    assert {x.tag: x.path for x in got.collect()} == {t: plain(t) for t in tags}


def test_pages_and_lines_are_read_once(spark):
    plan = lambda name: catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("page_chunks").count("split(") == 1
    assert plan("drawing_components").count("split(") == plan("drawing_connections").count("split(") == 2  # lines and cells
    assert catalog.queries()["drawing_components"](spark, SMALL).rdd.getNumPartitions() > 1
