"""Stars against plain joins of lists of rows: every match is made, then the first row of a key is kept."""

import random

import pytest

from tagwright.operators import stars


def text(v):
    t = "" if v is None else str(v).strip()
    t = t[:-2] if t.endswith(".0") else t
    return "" if t.lower() in ("nan", "none", "nat") else t


def join(left, right, on, suffix="_r", drop=()):
    """Every pair of rows whose keys read alike, left ones without a match too; ``left`` and ``right`` are lists of dicts."""
    out, names = [], [c for c in (right[0] if right else {}) if c not in (*on, *drop)]
    for a in left:
        met = [b for b in right if all(text(a[k]) == text(b[k]) for k in on)] or [{}]
        for b in met:
            out.append(a | {(c + suffix if c in left[0] else c): b.get(c) for c in names})
    return out


def first(rows, keys):
    seen = {}
    for r in rows:
        seen.setdefault(tuple(text(r[k]) for k in keys), r)
    return list(seen.values())


def summed(rows, keys, add):
    out = {}
    for r in rows:
        k = tuple(text(r[c]) for c in keys)
        if k not in out:
            out[k] = {c: None for c in r}
            out[k] |= dict(zip(keys, k))
        for c, v in r.items():
            if c in keys or v is None:
                continue
            out[k][c] = (out[k][c] or 0) + v if c in add else (v if out[k][c] is None else out[k][c])
    return list(out.values())


def frame(spark, rows, schema):
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return spark.createDataFrame([(*[r[c] for c in names], k) for k, r in enumerate(rows)], schema + ", seq long")


def told(rows):
    return sorted((sorted((k, str(v)) for k, v in r.items()) for r in rows), key=str)


@pytest.fixture(scope="module")
def sap(spark):
    r = random.Random(11)
    order = lambda: r.choice(["1", "2", "3.0", "4", None, "9"])
    few = lambda n, make: [make(k) for k in range(n)]
    rows = {
        "AUFK": (few(5, lambda k: {"AUFNR": f"{k}", "EQUNR": r.choice(["e1", "e2", None]), "TPLNR": r.choice(["l1", "l9"]), "STATUS": f"s{k}"}), "AUFNR string, EQUNR string, TPLNR string, STATUS string"),
        "AFKO": (few(4, lambda k: {"AUFNR": f"{k}.0", "AUFPL": f"x{k}", "STATUS": f"t{k}"}), "AUFNR string, AUFPL string, STATUS string"),
        "AFVC": (few(14, lambda k: {"AUFNR": order(), "AUFPL": r.choice(["p1", "p2"]), "VORNR": r.choice(["10", "20"]), "LTXA1": f"op{k}"}), "AUFNR string, AUFPL string, VORNR string, LTXA1 string"),
        "AFVV": (few(5, lambda k: {"AUFPL": r.choice(["p1", "p2"]), "VORNR": r.choice(["10", "20"]), "DAUNO_MIN": k, "NOT": "x"}), "AUFPL string, VORNR string, DAUNO_MIN long, NOT string"),
        "QMEL": (few(6, lambda k: {"AUFNR": order(), "QMNUM": f"q{k % 3}", "QMTXT": r.choice([None, f"m{k}"])}), "AUFNR string, QMNUM string, QMTXT string"),
        "QMSM": (few(6, lambda k: {"QMNUM": f"q{k % 4}", "MNCOD": f"c{k}"}), "QMNUM string, MNCOD string"),
        "JEST": (few(8, lambda k: {"OBJNR": f"OR{k % 4}", "STAT": f"I{k}"}), "OBJNR string, STAT string"),
        "RESB": (few(9, lambda k: {"AUFNR": order(), "MATNR": r.choice(["m1", "m2", "m3"]), "BDMNG": float(k), "MEINS": r.choice(["kg", None])}), "AUFNR string, MATNR string, BDMNG double, MEINS string"),
        "COEP": (few(9, lambda k: {"AUFNR": order(), "WTGBTR": float(2**k), "WAERS": f"w{k}"}), "AUFNR string, WTGBTR double, WAERS string"),
        "EQUI": ([{"EQUNR": "e1", "TPLNR": "l1", "STATUS": "up", "ILOAN": "a1"}, {"EQUNR": "e2", "TPLNR": "l2", "STATUS": "down", "ILOAN": None}], "EQUNR string, TPLNR string, STATUS string, ILOAN string"),
        "IFLOT": ([{"TPLNR": "l1", "PLTXT": "hall"}, {"TPLNR": "l2", "PLTXT": "yard"}], "TPLNR string, PLTXT string"),
        "ILOA": ([{"ILOAN": "a1", "SWERK": "P1"}], "ILOAN string, SWERK string"),
        "STXH": ([{"TDOBJECT": "AUFK", "TDNAME": "1", "TDID": "k1"}, {"TDOBJECT": "QMEL", "TDNAME": "2", "TDID": "k2"}, {"TDOBJECT": "AUFK", "TDNAME": "1", "TDID": "k3"}], "TDOBJECT string, TDNAME string, TDID string"),
        "MARA": ([{"MATNR": m, "MTART": t} for m, t in (("m1", "a"), ("m2", "b"), ("m3", "c"), ("m4", "d"))], "MATNR string, MTART string"),
        "MARC": ([{"MATNR": "m1", "WERKS": "A", "EKGRP": "g1"}, {"MATNR": "m1", "WERKS": "B", "EKGRP": None}, {"MATNR": "m2", "WERKS": "A", "EKGRP": "g3"}], "MATNR string, WERKS string, EKGRP string"),
        "MARD": ([{"MATNR": "m1", "WERKS": "A", "LGORT": "x"}, {"MATNR": "m1", "WERKS": "A", "LGORT": "y"}, {"MATNR": "m2", "WERKS": "A", "LGORT": None}], "MATNR string, WERKS string, LGORT string"),
        "PLKO": ([{"PLNNR": "p", "PLNAL": "1"}, {"PLNNR": "p", "PLNAL": "2"}, {"PLNNR": "z", "PLNAL": "1"}], "PLNNR string, PLNAL string"),
        "MAPL": ([{"PLNNR": "p", "PLNAL": "1", "EQUNR": "e1"}, {"PLNNR": "p", "PLNAL": "1", "EQUNR": "e2"}], "PLNNR string, PLNAL string, EQUNR string"),
        "PLPO": ([{"PLNNR": "p", "PLNAL": "9", "VORNR": v} for v in ("10", "20", "10")], "PLNNR string, PLNAL string, VORNR string"),
    }
    return {n: x for n, (x, _) in rows.items()}, {n: frame(spark, *x) for n, x in rows.items()}


def test_work_orders_keep_the_first_of_all_matches(sap):
    rows, tables = sap
    out = [r | {"OBJNR": "OR" + r["AUFNR"]} for r in rows["AUFK"]]
    out = join(out, rows["AFKO"], ["AUFNR"])
    operations = join(rows["AFVC"], rows["AFVV"], ["AUFPL", "VORNR"], drop=("NOT",))
    out = join(out, [{k: v for k, v in r.items() if k not in ("AUFPL", "DAUNO_MIN")} for r in operations], ["AUFNR"])
    out = join(out, [{k: r[k] for k in ("AUFNR", "VORNR", "DAUNO_MIN")} for r in operations], ["AUFNR", "VORNR"])
    out = join(out, first(rows["QMEL"], ["AUFNR"]), ["AUFNR"], "_QMEL")
    out = join(out, first(rows["QMSM"], ["QMNUM"]), ["QMNUM"], "_QMSM")
    out = join(out, rows["JEST"], ["OBJNR"])
    out = join(out, summed(rows["RESB"], ["AUFNR"], ["BDMNG"]), ["AUFNR"], "_RESB")
    out = join(out, summed(rows["COEP"], ["AUFNR"], ["WTGBTR"]), ["AUFNR"], "_COEP")
    out = join(out, rows["EQUI"], ["EQUNR"], "_EQUI")
    out = join(out, rows["IFLOT"], ["TPLNR"], "_IFLOT")
    texts = [{"AUFNR": r["TDNAME"], "TDID": r["TDID"]} for r in rows["STXH"] if r["TDOBJECT"] == "AUFK"]
    out = first(join(out, first(texts, ["AUFNR"]), ["AUFNR"]), ["AUFNR", "VORNR"])
    got = [r.asDict() for r in stars.work_orders(tables).collect()]
    assert told(got) == told(out) and {"STATUS_r", "STATUS_EQUI", "TPLNR_EQUI", "BDMNG", "WTGBTR", "TDID", "DAUNO_MIN"} <= set(got[0])


def test_locations_and_task_lists(sap):
    rows, tables = sap
    want = join(join(rows["EQUI"], rows["IFLOT"], ["TPLNR"]), rows["ILOA"], ["ILOAN"])
    assert told(r.asDict() for r in stars.locations(tables).collect()) == told(want)
    want = join(join(join(rows["PLKO"], rows["MAPL"], ["PLNNR", "PLNAL"]), rows["PLPO"], ["PLNNR"], "_PLPO"), rows["EQUI"], ["EQUNR"], "_EQUI")
    assert told(r.asDict() for r in stars.task_lists(tables).collect()) == told(first(want, ["PLNNR", "PLNAL", "VORNR"]))


def test_materials_sum_without_the_product(sap):
    rows, tables = sap
    out = join(join(rows["MARA"], rows["MARC"], ["MATNR"], "_MARC"), rows["MARD"], ["MATNR", "WERKS"], "_MARD")
    out = join(join(out, [{k: r[k] for k in ("MATNR", "AUFNR", "BDMNG")} for r in rows["RESB"]], ["MATNR"]), [{k: r[k] for k in ("AUFNR", "WTGBTR")} for r in rows["COEP"]], ["AUFNR"])
    want = [{k: v for k, v in r.items() if k != "AUFNR"} for r in summed(out, ["MATNR", "WERKS"], ["BDMNG", "WTGBTR"])]
    got = [r.asDict() | {"WERKS": r.WERKS or ""} for r in stars.materials(tables, ["BDMNG"], ["WTGBTR"]).collect()]
    assert told(got) == told(want)


def test_missing_tables_and_columns_are_left_out(spark, sap):
    _, tables = sap
    some = {k: tables[k] for k in ("AUFK", "QMSM", "IFLOT")} | {"COEP": tables["COEP"].drop("AUFNR")}
    assert set(stars.work_orders(some).columns) == {"AUFNR", "EQUNR", "TPLNR", "STATUS", "OBJNR", "PLTXT"}
    assert stars.work_orders({k: v.where("false") for k, v in tables.items()}).count() == 0
    with pytest.raises(Exception, match="keys repeat"):
        stars.locations({**tables, "IFLOT": tables["IFLOT"].union(tables["IFLOT"])}).collect()


@pytest.mark.parametrize("rows", [[("1", "b", 5), ("1", "a", 5)], [("1", "a", 5), ("1", "b", 5)]])
def test_ties_do_not_depend_on_the_order_of_rows(spark, rows):
    base = spark.createDataFrame([("1", 0)], "AUFNR string, seq int")
    other = spark.createDataFrame(rows, "AUFNR string, note string, seq int").coalesce(1)
    got = stars.star(base, {"X": other}, (stars.Step("X", ("AUFNR",), "first"),), ["AUFNR"])
    assert [r.note for r in got.collect()] == ["a"]


STEPS = (
    stars.Step("A", ("K",)),
    stars.Step("F", ("E",), "first", "_F"),
    stars.Step("S", ("K",), "sum", "_S"),
    stars.Step("C", ("X",), suffix="_C"),
    stars.Step("G", ("X",), "first", "_G"),
    stars.Step("H", ("W",), "first", "_H"),
    stars.Step("D", ("K",), "all", "_D"),
    stars.Step("N", ("E",), "first", "_N"),
)


@pytest.mark.parametrize("keys", [["K", "V"], ["K"], ["V", "U"], ["W", "V"], ["Z"], ["K", "V", "U", "P"]])
def test_rows_that_leave_early_are_no_first_ones(spark, keys):
    """Repeated base rows, equal orders, tables that hang on other tables' rows: against all matches in order."""
    r = random.Random(str(keys))
    pick = lambda *xs: r.choice([*xs, None])

    def made(n, schema, make):
        rows = sorted(({"seq": r.randrange(4)} | make() for _ in range(n)), key=lambda x: [(v is not None, v) for v in x.values()])
        names = [c.split(" ")[0] for c in schema.split(", ")]
        return [{k: x[k] for k in names} for x in rows], spark.createDataFrame([tuple(x[c] for c in names) for x in rows], schema).repartition(3)

    base, b = made(12, "K string, E string, Q int, seq int", lambda: {"K": pick("1", "1.0", "2", "7.0.0"), "E": pick("e", "f"), "Q": r.randrange(2)})
    rows, tables = {}, {}
    for name, n, schema, make in (
        ("A", 12, "K string, V string, X string, seq int", lambda: {"K": pick("1", "2.0", "7.0.0"), "V": pick("v", "w"), "X": pick("x", "y")}),
        ("F", 5, "E string, W string, seq int", lambda: {"E": pick("e", "f"), "W": pick("a", "b")}),
        ("S", 6, "K string, M int, seq int", lambda: {"K": pick("1", "2"), "M": r.randrange(9)}),
        ("C", 5, "X string, U string, seq int", lambda: {"X": pick("x", "y"), "U": pick("u", "o")}),
        ("G", 5, "X string, Z string, seq int", lambda: {"X": pick("x", "y"), "Z": pick("z", "q")}),
        ("H", 4, "W string, Y string, seq int", lambda: {"W": pick("a", "b"), "Y": pick("h", "i")}),
        ("D", 6, "K string, P string, seq int", lambda: {"K": pick("1", "2"), "P": pick("p", "r")}),
        ("N", 3, "E string, seq int", lambda: {"E": pick("e", "f")}),
    ):
        rows[name], tables[name] = made(n, schema, make)
    out = [{k if k != "seq" else "_o": v for k, v in x.items()} for x in base]
    for step in STEPS[:-1]:
        right, on = rows[step.table], list(step.on)
        seq = f"_o{step.table}" if step.rows == "all" else "-"
        right = [{k if k != "seq" else seq: v for k, v in x.items()} for x in right]
        right = first(right, on) if step.rows == "first" else summed(right, on, ["M"]) if step.rows == "sum" else right
        out = join(out, right, on, step.suffix, drop=("-",))
    place = lambda x: [(x[k] is not None, x[k]) for k in sorted(x, key=lambda k: k[:2] != "_o")]
    want = {}
    for x in sorted(out, key=place):
        want.setdefault(tuple(x[k] for k in keys), {k: v for k, v in x.items() if k[:2] != "_o"})
    assert told(x.asDict() for x in stars.star(b, tables, STEPS, keys).collect()) == told(want.values())


def test_work_orders_have_nothing_to_leave_out_at_the_end(sap):
    """Their rows are one a key as they meet, so no wide row moves for the first of them, and a row moves once."""
    query = stars.work_orders(sap[1])._jdf.queryExecution()
    top = [x.strip(" +-:") for x in query.optimizedPlan().toString().splitlines()]
    assert next(x for x in top if not x.startswith("Project")).startswith("Join")
    assert "min_by(struct" not in query.optimizedPlan().toString()
