"""Layered configuration against a plain recursive merge."""

import json
import random

from tagwright.operators import config


def plain_merge(base, over):
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: plain_merge(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in {**base, **over}}
    return over


def some(r, depth):
    kind = r.randrange(4 if depth else 3)
    if kind == 3:
        return {r.choice(["a", "b", "c d", 'q"é']): some(r, depth - 1) for _ in range(r.randrange(4))}
    return [r.randrange(5), "x\ny", None, [1, {"a": 2}], {}, True, 1.5][r.randrange(7)] if kind else "t"


def test_layers_merge_as_by_recursion(spark):
    r = random.Random(8)
    docs = {k: [{n: some(r, 4) for n in r.sample(["a", "b", "e"], r.randrange(4))} for _ in range(r.randrange(1, 5))] for k in range(120)}
    rows = [(k, i, json.dumps(d)) for k, own in docs.items() for i, d in enumerate(own)] + [(500, 1, None), (501, 1, None), (501, 2, '{"a": 1}')]
    got = {x.key: json.loads(x.doc) for x in config.deep_merged(spark.createDataFrame(rows, "key int, layer int, doc string")).collect()}
    want = {}
    for k, own in docs.items():
        want[k] = own[0]
        for d in own[1:]:
            want[k] = plain_merge(want[k], d)
    assert got == want | {501: {"a": 1}}


def test_plants_rename_over_defaults(spark):
    doc = json.dumps({"sap_processing": {"column_rename_overrides": {"P1": {"equi": {"mappings": {"EQUNR": "tag", "X": "note"}}}, "P2": {"other": {"mappings": {"A": "b"}}}}}})
    rows = config.mappings(spark.createDataFrame([(doc,)], "doc string"), "equi").collect()
    assert sorted(map(tuple, rows)) == [("P1", "EQUNR", "tag"), ("P1", "X", "note")]
    df = spark.createDataFrame([("P1", "e1", "n1", "x1"), ("P2", "e2", "n2", "x2"), (None, "e3", "n3", "x3")], "plant string, EQUNR string, EQKTX string, X string")
    out = config.renamed_by_plant(df, "plant", {"P1": {"EQUNR": "tag", "X": "note"}}, {"EQUNR": "equipment_id", "EQKTX": "tag"})
    assert out.columns == ["plant", "equipment_id", "tag", "note"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("P1", None, "e1", "x1"), ("P2", "e2", "n2", None), (None, "e3", "n3", None)], key=str)
    assert [tuple(x) for x in config.with_plant(spark.createDataFrame([("a", " "), ("b", "s")], "k string, site string"), "P9").collect()] == [("a", "-", "P9"), ("b", "s", "P9")]
