"""Budgets, breadth-first starts, numbering, registering and chains of issues against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagwright.operators import budget, numbering, registry

NODES = "node_id string, label string, seq long, properties map<string,string>"
EDGES = "relationship_id string, from_node_id string, to_node_id string, seq long, properties map<string,string>"


def plain_spend(nodes, edges, limit, seeds=(), properties=True):
    """The budget spent one thing after the other."""
    nodes, edges = sorted(nodes, key=lambda n: (n[2], n[0])), sorted(edges, key=lambda e: (e[3], e[0]))
    left, here, bought, taken = limit, set(seeds), [], []

    def edge():
        nonlocal left
        for e in edges if left >= 4 else ():
            if e not in taken and e[1] in here and e[2] in here:
                taken.append(e)
                left -= 4
                return True
        return False

    for n in nodes:
        if left < 2:
            break
        bought.append(n)
        here.add(n[0])
        left -= 2
        if len(bought) % 2 == 0:
            edge()
        if len(bought) % 10 == 0:
            edge()
            edge()
    if len(bought) == len(nodes) and nodes:
        while edge():
            pass
    out = []
    for x, props in [(n, n[3]) for n in bought] + [(e, e[4]) for e in taken]:
        kept = min(left, len(props or {})) if properties else 0
        left -= kept
        out.append((x[0], kept))
    return out


def told(nodes, edges):
    of = lambda df, key: [(r[key], len(r.properties or {})) for r in sorted(df.collect(), key=lambda r: r.place)]
    return of(nodes, "node_id") + of(edges, "relationship_id")


def hub(n):
    return [(f"n{k}", "Hub" if k == 0 else "Leaf", k, {"a": "1", "b": "2"} if k % 2 else None) for k in range(n)], [(f"e{k}", f"n{k}", "n0", -k, {"w": "1"}) for k in range(1, n)]


def chain(n):
    return [(f"n{k}", "Link", (k * 7) % n, {}) for k in range(n)], [(f"e{k}", f"n{k}", f"n{k + 1}", k, None) for k in range(n - 1)]


def tangle(n):
    r = random.Random(n)
    return [(f"n{k}", r.choice("ab"), r.randrange(n), {str(i): "v" for i in range(r.randrange(4))}) for k in range(n)], [(f"e{k}", f"n{r.randrange(n)}", f"n{r.randrange(n + 3)}", r.randrange(20), {"k": "v"}) for k in range(3 * n)]


@pytest.mark.parametrize("make, limits", [(hub, (1, 3, 60, 1000)), (chain, (45, 400)), (tangle, (90, 333, 5000))])
def test_a_budget_buys_what_a_plain_walk_buys(spark, make, limits):
    nodes, edges = make(40)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    for limit in limits:
        assert told(*budget.sample(n, e, limit)) == plain_spend(nodes, edges, max(1, min(1000, limit)))


def test_expanding_spends_on_neighbours(spark):
    nodes, edges = tangle(40)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    seeds, loaded = {"n1", "n2", "n9"}, {"e3", "e5", "e8"}
    near = {b for _, a, b, *_ in edges if a in seeds} | {a for _, a, b, *_ in edges if b in seeds}
    want = plain_spend([x for x in nodes if x[0] in near - seeds], [x for x in edges if x[0] not in loaded], 70, seeds, False)
    got = budget.expand(n, e, spark.createDataFrame([(s,) for s in seeds], "node_id string"), spark.createDataFrame([(s,) for s in loaded], "relationship_id string"), 70)
    assert [x for x, _ in told(*[df.withColumn("properties", F.create_map().cast("map<string,string>")) for df in got])] == [x for x, _ in want]
    none = budget.expand(n, e, spark.createDataFrame([("n999",)], "node_id string"), e.select("relationship_id").limit(0), 70)
    assert [df.count() for df in none] == [0, 0]


def plain_by_parents(nodes, edges, label, most):
    ids = {n[0] for n in nodes}
    front = sorted(n[0] for n in nodes if n[1].upper() == label.upper())[:most]
    seen = list(front)
    while front and len(seen) < most:
        rows = sorted((rank, a, b) for a in front for rank, b in enumerate(sorted(y for _, x, y, *_ in edges if x == a and y in ids)))
        front, left = [], most - len(seen)
        for _, _, b in rows[: 10 * left]:
            if b not in seen and len(seen) < most:
                seen.append(b)
                front.append(b)
    return seen, {e[0] for e in edges if e[1] in seen and e[2] in seen}


@pytest.mark.parametrize("make, most", [(hub, 12), (hub, 500), (chain, 17), (tangle, 3), (tangle, 25), (tangle, 500)])
def test_breadth_first_from_a_label(spark, make, most):
    nodes, edges = make(40)
    edges = edges + [(e[0] + "r", e[2], e[1], *e[3:]) for e in edges[::2]]
    label = nodes[0][1]
    found, among = budget.by_parents(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), label.lower(), most)
    want = plain_by_parents(nodes, edges, label, most)
    assert [r.node_id for r in sorted(found.collect(), key=lambda r: r.place)] == want[0]
    assert {r.relationship_id for r in among.collect()} == want[1]


def test_numbers_are_consecutive_over_partitions(spark):
    r = random.Random(1)
    rows = [(r.choice([None, *range(50)]), k) for k in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = numbering.numbered_whole(spark.createDataFrame(rows, "a int, uid long"), [F.desc_nulls_last("a"), "uid"], "n", 5)
        got = sorted(df.collect(), key=lambda x: x.n)
        assert df.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [x.n for x in got] == list(range(5, 505))
    assert [(x.a, x.uid) for x in got] == sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert numbering.numbered_whole(df.where("false"), ["a"]).count() == 0
    again = numbering.numbered_whole(df.select("a", "uid"), ["uid"])
    assert again.columns == ["a", "uid"] and sorted(x.uid for x in again.collect()) == list(range(1, 501))


RECORDS = "label string, key string, table string, pk string, plant string, source string, seq long, properties map<string,string>"


def plain_register(records, edited):
    nodes, aliases, seen = {}, set(), set()
    clean = lambda v: (v or "").strip()
    for label, key, table, pk, plant, source, _, props in sorted(records, key=lambda r: r[6]):
        key = clean(key).upper()
        table = "functional_location" if label == "FunctionalLocation" else table or "unknown"
        base = clean(pk) or (key if label in registry.KEYLESS else "")
        if not key or key == "NAN" or not base:
            continue
        nid, props = f"{base}#{table}", props or {}
        code = clean(props.get("asset_code")).upper() if label != "Plant" else ""
        number = clean(props.get("equipment_id")).upper() if label != "Plant" else ""
        plant = clean(plant).upper() if label != "Plant" else ""
        if (label, nid) not in seen:
            seen.add((label, nid))
            for a in {key, *([number, code] if label == "Equipment" else [])} - {""}:
                if a == key or a != "NONE":
                    aliases.add((label, a, plant, nid))
        own = {k: v for k, v in props.items() if clean(v)}
        if nid not in nodes:
            name = clean(props.get("normalized_asset")) if label == "Equipment" else ""
            first = {"name": name or key, "equipment_id": key if label == "Equipment" else "", "plant_code": plant, "asset_code": code}
            nodes[nid] = label, {}, defaultdict(list)
            own = {k: v for k, v in first.items() if v} | own
        _, held, lineage = nodes[nid]
        for k, v in own.items():
            held[k] = v
            if source not in lineage[k]:
                lineage[k].append(source)
    for nid, prop, value in edited:
        if nid in nodes:
            nodes[nid][1][prop], nodes[nid][2][prop] = value, ["ui_update"]
    return {k: (label, p, dict(x)) for k, (label, p, x) in nodes.items()}, aliases


def test_registering_is_the_plain_one(spark):
    r = random.Random(6)
    some = lambda *x: r.choice(x)
    records = []
    for k in range(400):
        props = {p: some("x", "y", " ", None, f"v{k}") for p in r.sample(["size", "asset_code", "equipment_id", "normalized_asset", "name", "w"], r.randrange(6))}
        records.append((some("Equipment", "Equipment", "Plant", "FunctionalLocation", "Sensor"), some("p-1", " P-1 ", "q2", "", None, "nan"), some("equipment_sap", "plant", None), some(None, " ", *map(str, range(12))), some("a", "", None), some("sap", "pid", "ts"), k, some(props, props, None)))
    edited = [("3#equipment_sap", "size", "by hand"), ("3#equipment_sap", "new", "by hand"), ("no#where", "size", "z")]
    nodes, aliases = registry.register(spark.createDataFrame(records, RECORDS), spark.createDataFrame(edited, "node_id string, property string, value string"))
    want = plain_register(records, edited)
    assert {x.node_id: (x.label, x.properties, x.lineage) for x in nodes.collect()} == want[0]
    assert {(x.label, x.alias, x.plant, x.node_id) for x in aliases.collect()} == want[1]


def test_chains_of_issues(spark):
    rows = [
        ("1", "e1", "n1", "leak", "flow", "seal", "look"), ("2", "e1", "n1", "leak", "flow", "seal", "listen"), ("3", "e1", "n1", "leak", "heat", "seal", None),
        ("4", "e1", "n1", "hum", "flow", "", "look"), ("5", "e2", None, "leak", "flow", "seal", "look"), (None, "e1", "n1", " leak ", "flow", None, "x"), ("7", "e3", "n3", None, "a", "b", "c"),
    ]
    nodes, edges = registry.issue_chains(spark.createDataFrame(rows, "row_id string, equipment string, node_id string, issue string, parameter string, cause string, check string"))
    got = {x.node_id: (x.label, x.name, x.properties) for x in nodes.collect()}
    assert got["1#symbolic_ai"] == ("Issue", "leak", {"name": "leak", "issue": "leak"})
    assert got["1_FLOW_SEAL_LOOK#symbolic_ai"] == ("Check", "look", {"name": "look", "check": "look"})
    assert got["3_HEAT#symbolic_ai"] == ("Parameter", "heat", {"name": "heat", "parameter": "heat", "cause": "seal"})
    assert got["4#symbolic_ai"] == ("Issue", "hum", {"name": "hum", "issue": "hum", "parameter": "flow", "check": "look"})
    assert got["_FLOW#symbolic_ai"] == ("Parameter", "flow", {"name": "flow", "parameter": "flow", "check": "x"})
    assert len(got) == 4 + 4 + 2 + 1 + 1
    told = {(e.from_node_id, e.rel_type, e.to_node_id) for e in edges.collect()}
    assert ("n1", "HAS_SYMBOLIC", "1#symbolic_ai") in told and ("1_FLOW#symbolic_ai", "HAS_CAUSE", "1_FLOW_SEAL#symbolic_ai") in told
    assert not any("_FLOW#symbolic_ai" == e[2] or "e2" in e[0] for e in told) and len(told) == 4 + 4 + 2 + 1
