import pytest
from pyspark.sql import functions as F

from tagwright.functions import coerce
from tagwright.functions import text as x
from tagwright.operators import gates, graph, joins, merge
from tagwright.operators import tables as t
from tagwright.operators import timeseries as ts
from tagwright.plans import catalog
from tagwright.sources import tables as src
from tagwright.streaming import live
from tests.conftest import SMALL


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_text(spark):
    assert [one(spark, x.normalize_asset, v) for v in ("  pump  1 ", "NaN", None, "NaT")] == ["PUMP 1", "", "", ""]
    assert [one(spark, x.normalize_tag, v) for v in ("SITE P-101", "big pump", "P-101")] == ["P101", "BIGPUMP", "P101"]
    assert [one(spark, x.measurement_name, v) for v in ("1300FI-685", "FI/685", "Temp(°C)", "tag#1", "已经", None)] == ["1300FI_685", "FI_685", "TempC", "tag1", "", "None"]
    assert [one(spark, x.basename, v) for v in ("a\\b/c.pdf", "c.pdf", None)] == ["c.pdf", "c.pdf", ""]
    assert one(spark, x.floc_levels, "BOCP.ELG/MGE\\A7510") == ["BOCP", "ELG", "MGE", "A7510"]
    assert one(spark, lambda c: x.chunks(c, 4, 1), "abcdefgh") == ["abcd", "defg", "gh"]
    assert one(spark, x.redact, "password=abc x") == "password=*** x"
    assert one(spark, lambda c: x.fold_vocabulary(c, {"slight_release": "slight_release"}), "Slight Release") == "slight_release"


def test_coercion(spark):
    assert [tuple(one(spark, coerce.numeric_limit, v)) for v in ("1.5k", "1,000", "-", "abc", None)] == [(1500.0, None), (1000.0, None), (None, "placeholder"), (None, "non-numeric:abc"), (None, None)]
    assert [one(spark, coerce.truth, v) for v in ("Yes", "0", "maybe")] == [True, False, None]
    assert str(one(spark, coerce.timestamp, "31/12/2024")).startswith("2024-12-31")
    assert one(spark, coerce.timestamp, "no date") is None
    assert one(spark, coerce.epoch_ms, "1700000000") == 1_700_000_000_000


def test_lookup_keeps_both_columns_and_meets_empty_keys(spark):
    left = spark.createDataFrame([("100", "OPEN"), ("100.0", "OPEN"), ("nan", "X")], "AUFNR string, STATUS string")
    right = spark.createDataFrame([("100", "DONE"), (None, "NONE")], "AUFNR string, STATUS string")
    assert rows(joins.lookup(left, right, ["AUFNR"])) == [("100", "OPEN", "DONE"), ("100.0", "OPEN", "DONE"), ("nan", "X", "NONE")]
    with pytest.raises(Exception, match="keys repeat"):
        joins.lookup(left, right.union(right), ["AUFNR"], many_to_one=True).collect()


def test_collapse_reads_text_numbers(spark):
    df = spark.createDataFrame([("1000", "1,100", None, 1), ("1000", "1,200", "b", 2), ("1000", "1,300", "c", 3)], "AUFNR string, DMBTR string, T string, seq int")
    assert rows(t.collapse(df, ["AUFNR"], ["DMBTR"], "seq").select("AUFNR", "DMBTR", "T")) == [("1000", 3600.0, "b")]


def test_rename_conform_and_names(spark):
    df = spark.createDataFrame([("E1", "Pump", "x")], "EQUNR string, EQKTX string, OTHER string")
    named = t.rename(df, {"equnr": "equipment_id", "EQ-KTX": "description"})
    assert named.columns == ["equipment_id", "description", "OTHER"]
    assert rows(t.conform(named, {"equipment_id": "string", "created_at": "timestamp"})) == [("E1", None)]
    assert t.normalize_columns(spark.createDataFrame([(1, 2, 3)], ["A b", "a-B", " "])).columns == ["a_b", "a_b_2", "column_3"]
    assert t.rename(spark.createDataFrame([(1, 2)], ["FLOC", "FUNC. LOC"]), {"floc": "f", "func loc": "f"}, {"f": ["FUNC LOC"]}).columns == ["FLOC", "f"]


def test_merges(spark):
    old = spark.createDataFrame([("u1", "a", 1), ("u2", "b", 2), ("u1", "later", 3)], "k string, v string, n int")
    new = spark.createDataFrame([("u1", " ", None), ("u3", "c", 4)], "k string, v string, n int")
    assert rows(merge.merge_on_write(new, old, ["k"], "n")) == [("u1", "a", 1), ("u2", "b", 2), ("u3", "c", 4)]
    stored = spark.createDataFrame([(1, "x", "ann"), (2, "y", None)], "id int, v string, edited_by string")
    come = spark.createDataFrame([(1, "new", None), (2, "new", None)], "id int, v string, edited_by string")
    assert [(r.id, r.v, r.outcome) for r in merge.guarded_upsert(come, stored, ["id"]).orderBy("id").collect()] == [(1, "x", "kept"), (2, "new", "updated")]
    maps = "id int, properties map<string,string>, lineage map<string,string>"
    a = spark.createDataFrame([(1, {"p": "ui", "q": "1"}, {"p": "ui_update"})], maps)
    b = spark.createDataFrame([(1, {"p": "sap", "q": "2"}, {"p": "sap", "q": "sap"}), (2, {"z": "1"}, None)], maps)
    got = {r.id: (r.properties, r.lineage) for r in merge.merge_properties(b, a, "id").collect()}
    assert got == {1: ({"p": "ui", "q": "2"}, {"p": "ui_update", "q": "sap"}), 2: ({"z": "1"}, {})}


def test_stable_keys(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y"), ("C", 3, "p"), ("C", 4, "q"), ("D", 5, "z"), ("D", 5, "z")], "base string, v int, w string")
    assert t.stable_keys(df, "base").select("stable_key").distinct().count() == 5
    alike = spark.createDataFrame([("C", 2847), ("C", 50983)], "base string, v int")  # digests begin with the same 32 bits
    assert t.stable_keys(alike, "base").select("stable_key").distinct().count() == 2


def test_series(spark):
    s = spark.createDataFrame([("a", k, 1.0 if k > 3 else float(k)) for k in range(12)] + [("b", k, None if 2 <= k < 6 else 0.0) for k in range(9)], "sensor string, m int, value double")
    s = s.select("sensor", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m)").alias("ts"), "value")
    assert {r.sensor: r.frozen_rows for r in ts.frozen(s).collect()} == {"a": 8, "b": 5}
    assert [(r.sensor, r.zero_rows, r.status) for r in ts.stuck_at_zero(s).collect()] == [("b", 5, "FAIL")]
    assert [(r.sensor, r.rows) for r in ts.null_bursts(s).collect()] == [("b", 4)]
    assert {r.sensor: (r.gap_count, r.expected_us) for r in ts.intervals(s).collect()} == {"a": (0, 60_000_000), "b": (0, 60_000_000)}
    assert ts.quality_score(s.where("false")).first().score == 100.0
    with pytest.raises(ValueError):
        ts.transpose_codes(spark.createDataFrame([("T1", "XX", "1")], "tag string, code string, v string"), ["tag"], "code", "v", {"HI": "high"})


def test_gates_on_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("E1",), ("E1",), ("E2",)], "equipment_id string")
    assert gates.natural_key(df, ["equipment_id"]).first()["status"] == "WARN"
    assert gates.natural_key(spark.createDataFrame([(None,), (None,), ("E1",)], "equipment_id string"), ["equipment_id"]).first()["status"] == "BLOCK"
    assert gates.basics(df.where("false")).first().missing_pct == 0.0


def test_graph_path_with_a_cycle_and_an_island(spark):
    e = spark.createDataFrame([(f"e{k}", str(k), str(k + 1), "T") for k in range(8)] + [("c", "3", "0", "T"), ("i", "x", "y", "T")], "relationship_id string, from_node_id string, to_node_id string, rel_type string")
    got = {r.node_id: r.hops for r in graph.distances(e, "0").collect()}
    assert got == {"0": 0, "1": 1, "2": 2, "3": 1, "4": 2, "5": 3, "6": 4, "7": 5, "8": 6}
    assert graph.tree(e, "5", ["T"]).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "EQUI.csv").write_text(" equipment_id ,name\nE1,\n")
    df = src.read(spark, src.resolve(spark, str(tmp_path), "EQUI"))
    assert rows(df) == [("E1", "")] and df.columns == ["equipment_id", "name"]
    with pytest.raises(FileNotFoundError):
        src.resolve(spark, str(tmp_path), "NONE")
    assert src.files(spark, str(tmp_path), "*.csv").count() == 1
    src.replace(df, "equi_stored")
    src.replace(spark.table("equi_stored").union(df), "equi_stored")
    assert spark.table("equi_stored").count() == 2


def test_stream_drops_repeats(spark, tmp_path):
    a = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:01")], "id int, t string").select("id", F.to_timestamp("t").alias("ts"))
    a.write.parquet(str(tmp_path / "in"))
    out = live.once_each(live.samples(spark, str(tmp_path / "in"), "id int, ts timestamp"), ["id"], "ts")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_lookup_is_collapsed_before_it_fans_out(spark):
    left = spark.createDataFrame([("1", "b", None), ("1", "a", "z"), ("2", "c", "y"), ("3", None, "x"), (None, "n", "n")], "k string, s string, p string")
    right = spark.createDataFrame([("1.0", "5", 2, None), ("1", "1,000", 1, "w"), ("2", None, None, "v"), ("9", "7", 0, "u")], "k string, q string, n int, note string")
    got = joins.collapsed_lookup(left, right, ["k"], ["q"], "n")
    assert rows(got) == rows(t.collapse(joins.lookup(left, right, ["k"]), ["k"], ["q"], "n").select(*got.columns))
    plan = catalog.queries()["fanout_collapse"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]  # no aggregate over what the join makes
