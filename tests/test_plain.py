"""Operators against plain versions, and errors that a query must raise."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tagwright.operators import graph, identity, joins, merge
from tagwright.sources import tables


def plain_series(key, reference):
    numbers = lambda x: [n.lstrip("0") or "0" for n in re.findall(r"\d+", x)]
    letters = lambda x: re.sub(r"^.*\d", "", x) if re.search(r"\d", x) else ""
    same = lambda x: numbers(x) == numbers(key) and letters(x) == letters(key)
    exact = [a for k, a in reference if k == key]
    if exact:
        return exact[0], "exact", 1.0
    if len(key) < 3:
        return "", "key_too_short" if key else "none", 0.0
    inside = sorted((abs(len(k) - len(key)), k, i) for i, (k, _) in enumerate(reference) if len(k) >= 3 and (k in key or key in k) and same(k))
    if inside:
        return reference[inside[0][2]][1], "contains", 0.92
    near = [x for x in reference if x[0].startswith(key[:3])] or reference
    scored = [(SequenceMatcher(None, key, k).ratio(), -i, a) for i, (k, a) in enumerate(near) if same(k)]
    best = max(scored, default=(0, 0, ""))
    return (best[2], "fuzzy", best[0]) if best[0] >= 0.84 else ("", "none", 0.0)


def test_series_identity_is_the_plain_one(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["AB", "KLNPUMP", "KLNPUMQ", "X", "12", "012", "7"]) for _ in range(r.randint(1, 4))) + r.choice(["", "A", "B"])
    reference = [(word(), f"asset{k}") for k in range(150)]
    keys = [word() for _ in range(200)] + ["", "A"]
    ref = spark.createDataFrame([(k, a, i) for i, (k, a) in enumerate(reference)], "key string, asset string, seq int")
    got = {x.row: (x.asset, x.method, x.confidence) for x in identity.series(spark.createDataFrame(list(enumerate(keys)), "row int, key string"), "row", "key", ref).collect()}
    want = {k: plain_series(x, reference) for k, x in enumerate(keys)}
    assert {"exact", "contains", "fuzzy", "none", "key_too_short"} <= {m for _, m, _ in want.values()}
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9 for k in want)


def plain_edges(edges, symmetric):
    kept = {}
    for _, a, b, kind, priority in sorted(edges):
        if a is None or b is None or a == b:
            continue
        kind = kind.strip().upper().replace(" ", "_")
        if kind in symmetric and kept.get((b, a), ("",))[0] == kind:
            continue
        old = kept.get((a, b))
        if old is None or priority > old[1]:
            kept[a, b] = kind if old is None or kind != old[0] else old[0], priority
    return {(a, b, *v) for (a, b), v in kept.items()}


def test_one_edge_each_is_the_plain_one(spark):
    r = random.Random(3)
    edges = [(k, f"n{r.randrange(5)}", f"n{r.randrange(5)}", r.choice(["flow to", "PART_OF", " connected_to "]), r.randrange(4)) for k in range(400)] + [(1000, None, "n1", "x", 1)]
    df = spark.createDataFrame(edges, "seq int, from_node_id string, to_node_id string, rel_type string, priority int")
    got = {tuple(x) for x in graph.one_edge_each(df, ["FLOW_TO", "CONNECTED_TO"]).collect()}
    assert got == plain_edges(edges, {"FLOW_TO", "CONNECTED_TO"})


def test_keys_inside_texts(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ABP-1 ") for _ in range(n))
    long, short = [word(r.randint(0, 14)) for _ in range(120)], list({word(r.randint(1, 6)) for _ in range(80)})
    got = {(x.id, x.key) for x in identity.contained(spark.createDataFrame(list(enumerate(long)), "id int, text string"), spark.createDataFrame([(s,) for s in short], "key string")).collect()}
    assert got == {(i, s) for i, t in enumerate(long) for s in short if s in t} and got


def test_errors_that_a_query_raises(spark):
    twice = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    with pytest.raises(Exception, match="keys repeat"):
        joins.lookup(spark.createDataFrame([("a",)], "k string"), twice, ["k"], many_to_one=True).collect()
    for bad in (twice.where("k = 'a'"), twice.where("k is null")):
        with pytest.raises(Exception, match="repeated id|without an id"):
            merge.replace_strictly(bad, twice, "k").collect()


def test_a_stored_table_is_replaced_by_what_it_gives(spark):
    tables.replace(spark.range(3).withColumn("x", F.lit(0)), "shelf")
    for _ in range(2):
        tables.replace(spark.table("shelf").withColumn("x", F.col("x") + 1), "shelf")
    assert sorted((r.id, r.x) for r in spark.table("shelf").collect()) == [(0, 2), (1, 2), (2, 2)]
    assert sum(t.name.startswith("shelf_v") for t in spark.catalog.listTables()) == 1
    spark.sql("DROP VIEW shelf")


def test_a_name_is_resolved_at_any_depth_and_parquet_first(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/a/b/c/work_order_1.parquet")
    spark.range(1).write.csv(f"{tmp_path}/a/b/c/work_order_2.csv")
    assert tables.resolve(spark, str(tmp_path), "work_order").endswith("work_order_1.parquet")
    spark.range(1).write.csv(f"{tmp_path}/work_order.csv")
    assert tables.resolve(spark, str(tmp_path), "work_order").endswith("/work_order.csv")
    with pytest.raises(FileNotFoundError):
        tables.resolve(spark, str(tmp_path), "nothing")
