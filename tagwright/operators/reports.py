"""What a data-quality report says of samples in long form (sensor, ts, value): overview, missing values, repeats, first spikes, first gaps, a summary of all checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.operators import timeseries as ts


def overview(df: DataFrame) -> DataFrame:
    """One row: n_rows, sensors, null_times, first and last time, minutes between them. An empty table has zeros and no times."""
    return df.groupBy("sensor").agg(F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("no_ts"), F.min("ts").alias("a"), F.max("ts").alias("b")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("sensor").alias("sensors"), F.coalesce(F.sum("no_ts"), F.lit(0)).alias("null_times"), F.min("a").alias("first"), F.max("b").alias("last"), F.round(F.timestamp_diff("MICROSECOND", F.min("a"), F.max("b")) / 60_000_000, 2).alias("minutes")
    )


def _first(df: DataFrame, order: list[Column], most: int, what: Column) -> DataFrame:
    """sensor and the first ``most`` of its rows as an array. They are cut before rows move: a busy sensor sends ``most`` rows a task."""
    place = F.row_number().over(Window.partitionBy("sensor").orderBy(*order))
    rows = df.withColumn("_place", place).where(F.col("_place") <= most)
    return rows.groupBy("sensor").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_place").alias("p"), what.alias("w")))), lambda x: x["w"]).alias("first"))


def missing_values(df: DataFrame, most: int = 5) -> DataFrame:
    """Sensors with nulls: missing, missing_pct of their rows, and the times of the first ``most``."""
    n = df.groupBy("sensor").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("_n")).where("missing > 0")
    first = _first(df.where("value is null"), [F.asc_nulls_last("ts")], most, F.col("ts")).withColumnRenamed("first", "null_times")
    return n.join(first, "sensor").select("sensor", "missing", F.round(F.col("missing") / F.col("_n") * 100, 2).alias("missing_pct"), "null_times")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """sensor, full_duplicates (rows beyond the first of equal time and value), ts_duplicates (of equal time), status: FAIL if rows repeat in full."""
    g = df.groupBy("sensor", "ts", "value").agg(F.count("*").alias("n")).groupBy("sensor", "ts").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    out = g.groupBy("sensor").agg(F.sum(F.col("n") - F.col("kinds")).alias("full_duplicates"), F.sum(F.col("n") - 1).alias("ts_duplicates"))
    return out.withColumn("status", F.when(F.col("full_duplicates") > 0, "FAIL").otherwise("PASS"))


def first_spikes(df: DataFrame, k: float = 5.0, most: int = 10) -> DataFrame:
    """sensor, spike_count, and its first ``most`` spikes (ts, value, deviation in standard deviations)."""
    found = ts.spikes(df, k)
    n = found.groupBy("sensor").agg(F.count("*").alias("spike_count"))
    first = _first(found, [F.col("ts"), F.col("value")], most, F.struct("ts", "value", F.round("deviation", 2).alias("deviation"))).withColumnRenamed("first", "spikes")
    return n.join(first, "sensor")


def first_gaps(df: DataFrame, most: int = 50) -> DataFrame:
    """sensor and its first ``most`` gaps (after, seconds): steps between samples longer than the most frequent one. Steps are found by day, and over midnights."""
    us = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    rows = ts.dated(df.where("ts is not null").select("sensor", "ts"))
    within = rows.select("sensor", F.lag("ts").over(ts.by_day()).alias("after"), F.col("ts").alias("to"))
    ends = rows.groupBy("sensor", "day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    steps = within.union(ends.select("sensor", F.lag("last").over(ts.days()), F.col("first"))).where("after is not null").withColumn("step", us(F.col("after"), F.col("to")))
    usual = ts.intervals(df).select("sensor", "expected_us")
    return _first(steps.join(usual, "sensor").where("step > expected_us"), [F.col("after")], most, F.struct("after", (F.col("step") / 1_000_000).alias("seconds"))).withColumnRenamed("first", "gaps")


def checks_summary(df: DataFrame, spike_k: float = 5.0, frozen_rows: int = 5, zero_rows: int = 5, burst: int = 3, ratio: float = 0.001, pairs: DataFrame | None = None) -> DataFrame:
    """check, affected, total, affected_pct, count: of sensors hit by each check, of rows that repeat, of gaps; ``pairs`` are duplicate signals (a, b).

    ``count`` is the number of spikes, of pairs, of repeated rows or of missing samples.
    """
    none = F.lit(0).cast("long")
    n = df.groupBy("sensor").agg(F.count("*").alias("n"), F.count("value").alias("filled")).agg(F.count("*").alias("sensors"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("filled") < F.col("n")).alias("missing"))
    row = lambda found, check, count=none, affected=None: found.agg((F.count("*") if affected is None else affected).alias("affected"), F.coalesce(count, F.lit(0)).cast("long").alias("count")).select(F.lit(check).alias("check"), "affected", "count")
    gaps = ts.intervals(df)
    checks = [
        n.select(F.lit("missing_values").alias("check"), F.col("missing").alias("affected"), none.alias("count")),
        row(ts.frozen(df, frozen_rows), "frozen_signals"),
        row(ts.stuck_at_zero(df, zero_rows), "stuck_at_zero"),
        row(ts.dead(df, ratio), "dead_sensors"),
        row(ts.spikes(df, spike_k).groupBy("sensor").agg(F.count("*").alias("n")), "spikes", F.sum("n")),
        row(ts.null_bursts(df, burst), "null_bursts"),
        row(duplicate_rows(df), "duplicate_rows", F.sum("full_duplicates"), F.coalesce(F.sum("full_duplicates"), F.lit(0))),
        row(gaps.where("gap_count > 0"), "timestamp_gaps", F.sum("missing_slots")),
    ]
    if pairs is not None:
        checks.append(row(pairs, "duplicate_signals", F.count("*"), F.count("*") * 2))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    total = F.greatest(F.when(F.col("check") == "duplicate_rows", F.col("rows")).otherwise(F.col("sensors")), F.lit(1))
    out = out.join(F.broadcast(n.select("sensors", "rows"))).withColumn("total", total)  # one row
    return out.select("check", "affected", "total", F.round(F.col("affected") / F.col("total") * 100, 2).alias("affected_pct"), "count")
