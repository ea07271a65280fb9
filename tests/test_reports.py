"""The series report on the fixture of its checks, and on nothing."""

import datetime

from pyspark.sql import functions as F

from tagwright.operators import reports

START = datetime.datetime(2024, 1, 1, 23, 0)


def frame(spark, rows):
    return spark.createDataFrame([(s, None if k is None else START + datetime.timedelta(minutes=k), v) for s, k, v in rows], "sensor string, ts timestamp_ntz, value double")


def samples():
    rows = []
    for k in range(200):
        if k == 90:
            continue  # one gap
        at = 61 if k == 60 else k  # one time twice
        rows.append(("spike", at, 500.0 if k in (20, 150) else k % 3.0))
        rows.append(("frozen", at, 7.0 if k > 190 else float(k)))
        rows.append(("zero", at, 0.0 if k > 180 else float(k)))
        rows.append(("burst", at, None if 100 <= k < 104 or k == 3 else float(k)))
        rows.append(("dead", at, None))
    return rows


def test_the_fixture(spark):
    df = frame(spark, samples() + [("twice", 0, 1.0), ("twice", 0, 1.0), ("twice", 0, 2.0)])
    got = {x.check: (x.affected, x.total, x.affected_pct, x["count"]) for x in reports.checks_summary(df, pairs=df.where("sensor = 'zero'").limit(1).select(F.lit("x").alias("a"), F.lit("y").alias("b"))).collect()}
    assert got == {
        "missing_values": (2, 6, 33.33, 0), "frozen_signals": (2, 6, 33.33, 0), "stuck_at_zero": (2, 6, 33.33, 0), "dead_sensors": (1, 6, 16.67, 0), "spikes": (1, 6, 16.67, 2),
        "null_bursts": (2, 6, 33.33, 0), "duplicate_rows": (2, 998, 0.2, 2), "timestamp_gaps": (5, 6, 83.33, 10), "duplicate_signals": (2, 6, 33.33, 1),
    }
    spikes = {x.sensor: (x.spike_count, [(s.ts, s.value) for s in x.spikes]) for x in reports.first_spikes(df, most=1).collect()}
    assert spikes == {"spike": (2, [(START + datetime.timedelta(minutes=20), 500.0)])}
    missing = {x.sensor: (x.missing, x.missing_pct, [int((t - START).total_seconds() // 60) for t in x.null_times]) for x in reports.missing_values(df, 3).collect()}
    assert missing == {"burst": (5, 2.51, [3, 100, 101]), "dead": (199, 100.0, [0, 1, 2])}
    gaps = {x.sensor: [(int((g.after - START).total_seconds() // 60), g.seconds) for g in x.gaps] for x in reports.first_gaps(df.where("sensor = 'zero'")).collect()}
    assert gaps == {"zero": [(59, 120.0), (89, 120.0)]}
    repeats = {x.sensor: (x.full_duplicates, x.ts_duplicates, x.status) for x in reports.duplicate_rows(df).collect()}
    assert repeats["twice"] == (1, 2, "FAIL") and repeats["frozen"] == (0, 1, "PASS") and repeats["dead"] == (1, 1, "FAIL")
    one = reports.overview(df).first()
    assert (one.n_rows, one.sensors, one.null_times, one.minutes, one["first"]) == (998, 6, 0, 199.0, START)


def test_nothing_and_nulls(spark):
    none = frame(spark, [])
    assert reports.overview(none).first().n_rows == 0 and reports.missing_values(none).count() == 0 and reports.first_gaps(none).count() == 0
    assert {x.affected for x in reports.checks_summary(none).collect()} == {0}
    odd = frame(spark, [("a", None, 1.0), ("a", None, None), ("a", 1, 2.0)])
    one = reports.overview(odd).first()
    assert (one.n_rows, one.null_times, one.minutes) == (3, 2, 0.0)
