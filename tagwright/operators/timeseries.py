"""Samples of sensors in long form (sensor, ts, value), and their quality checks.

Checks are aggregates wherever one can answer: a frozen tail is what comes after the last different sample, not a walk
back through a sorted series. Only intervals and bursts of nulls need neighbours: windows are by sensor and day, and what
crosses midnight is put together over one row a sensor and day, so that no busy sensor is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_day():
    return Window.partitionBy("sensor", "day").orderBy("ts")


def days():
    return Window.partitionBy("sensor").orderBy("day")


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("ts"))


def retain(df: DataFrame, key: str, ts: str, window: str) -> DataFrame:
    """Rows within ``window`` (an interval such as ``7 days``) of their key's newest, the border included."""
    newest = df.groupBy(key).agg((F.max(ts) - F.expr(f"interval {window}")).alias("_least"))
    return df.join(newest, key).where(F.col(ts) >= F.col("_least")).drop("_least")


def melt(df: DataFrame, ts: str, sensors: list[str]) -> DataFrame:
    return df.unpivot([ts], sensors, "sensor", "value").withColumnRenamed(ts, "ts")


def pivot(df: DataFrame, sensors: list[str]) -> DataFrame:
    """One row a time, one column a sensor, the first value of each (the smallest of several)."""
    return df.groupBy("ts").pivot("sensor", sensors).agg(F.min("value"))


def transpose_codes(df: DataFrame, keys: list[str], code: str, value: str, codes: dict[str, str]) -> DataFrame:
    """Rows of codes as columns. A code that is not declared, or two values in one cell, is an error."""
    if not df.where(~F.col(code).isin(*codes)).isEmpty():
        raise ValueError("undeclared code")
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col(code) == k, F.col(value))).alias(v) for k, v in codes.items()])
    twice = df.where(F.col(value).isNotNull()).groupBy(*keys, code).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("two values in one cell")
    return wide


def intervals(df: DataFrame) -> DataFrame:
    """Per sensor: expected interval (the most frequent, the smallest on ties), repeated times, irregular intervals, gaps and missing samples."""
    us = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    rows = dated(df.where("ts is not null").select("sensor", "ts"))
    within = rows.select("sensor", us(F.lag("ts").over(by_day()), F.col("ts")).alias("step"))
    ends = rows.groupBy("sensor", "day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    step = within.union(ends.select("sensor", us(F.lag("last").over(days()), F.col("first")).alias("step"))).where("step is not null")
    n = step.groupBy("sensor", "step").agg(F.count("*").alias("n"))
    mode = n.groupBy("sensor").agg(F.min_by("step", F.struct(-F.col("n"), F.col("step"))).alias("expected_us"))
    all_ = n.join(mode, "sensor")
    gap, times = F.col("step") > F.col("expected_us"), F.col("n")
    missing = F.when(gap & (F.col("expected_us") > 0), times * F.greatest(F.floor(F.col("step") / F.col("expected_us")) - 1, F.lit(0)))
    return all_.groupBy("sensor").agg(
        F.first("expected_us").alias("expected_us"),
        F.sum(F.when(F.col("step") == 0, times).otherwise(0)).alias("duplicate_timestamps"),
        F.sum(F.when(F.col("step") != F.col("expected_us"), times).otherwise(0)).alias("irregular_intervals"),
        F.sum(F.when(gap, times).otherwise(0)).alias("gap_count"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("missing_slots"),
    )


def spikes(df: DataFrame, k: float = 5.0) -> DataFrame:
    """Samples further than ``k`` standard deviations from their sensor's mean, with at least four samples and some spread."""
    stats = df.where("value is not null").groupBy("sensor").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n")).where("n >= 4 and std >= 1e-9")
    return df.join(stats, "sensor").where(F.abs(F.col("value") - F.col("mean")) > k * F.col("std")).withColumn("deviation", F.abs(F.col("value") - F.col("mean")) / F.col("std"))


def frozen(df: DataFrame, least: int = 5) -> DataFrame:
    """Sensors whose last samples, ``least`` or more, are equal: value, rows, since."""
    some = df.where("value is not null")
    last = some.groupBy("sensor").agg(F.max_by("value", F.struct("ts", "value")).alias("frozen_value"))
    marked = some.join(last, "sensor")
    other = marked.where("value <> frozen_value").groupBy("sensor").agg(F.max("ts").alias("_other"))
    tail = marked.join(other, "sensor", "left").where("_other is null or ts > _other")
    return tail.groupBy("sensor", "frozen_value").agg(F.count("*").alias("frozen_rows"), F.min("ts").alias("since")).where(F.col("frozen_rows") >= least)


def stuck_at_zero(df: DataFrame, window: int = 5) -> DataFrame:
    """Sensors with zeros among their last samples that are not null; FAIL if all of a full window are zero."""
    down = Window.partitionBy("sensor").orderBy(F.desc("ts"), "value")
    tail = df.where("value is not null").withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= window)
    zeros = tail.groupBy("sensor").agg(F.count_if(F.col("value") == 0).alias("zero_rows")).where("zero_rows > 0")
    return zeros.withColumn("status", F.when(F.col("zero_rows") >= window, "FAIL").otherwise("WARN"))


def dead(df: DataFrame, ratio: float = 0.001) -> DataFrame:
    """Sensors with next to no different values, or none at all."""
    per = df.groupBy("sensor", "value").agg(F.count("*").alias("n")).groupBy("sensor")
    per = per.agg(F.count("value").alias("unique_values"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("samples"))
    share = F.when(F.col("samples") == 0, 0.0).otherwise(F.col("unique_values") / F.col("samples"))
    return per.withColumn("unique_ratio", share).where(F.col("unique_ratio") <= ratio)


def null_bursts(df: DataFrame, least: int = 3) -> DataFrame:
    """Longest run of nulls of each sensor, with its start, if it has ``least`` or more (the earliest of equals)."""
    rows = dated(df).withColumn("_b", F.count("value").over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    # runs within a day; a day's first and last one may go on in the days beside it
    runs = rows.groupBy("sensor", "day", "_b").agg(F.count_if(F.col("value").isNull()).alias("rows"), F.min(F.when(F.col("value").isNull(), F.col("ts"))).alias("start"))
    per_day = runs.groupBy("sensor", "day").agg(F.max("_b").alias("filled"))
    order = per_day.withColumn("_before", F.coalesce(F.count_if(F.col("filled") > 0).over(days().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.where("rows > 0").join(order, ["sensor", "day"])
    edge = F.when(F.col("_b") == 0, F.col("_before")).when(F.col("_b") == F.col("filled"), F.col("_before") + 1)
    inner = F.when(edge.isNull(), F.concat_ws("/", F.col("day").cast("string"), F.col("_b").cast("string")))
    runs = runs.groupBy("sensor", edge.alias("_edge"), inner.alias("_inner")).agg(F.sum("rows").alias("rows"), F.min("start").alias("start"))
    best = runs.groupBy("sensor").agg(F.max("rows").alias("rows"), F.min_by("start", F.struct(-F.col("rows"), F.col("start"))).alias("start"))
    return best.where(F.col("rows") >= least)


def duplicate_signals(wide: DataFrame, sensors: list[str], percentile: float = 0.995) -> DataFrame:
    """Pairs of sensors whose correlation is at least that percentile of all pairs'. ``wide`` has a column a sensor; one pass for all pairs."""
    pairs = [(a, b) for i, a in enumerate(sensors) for b in sensors[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(F.corr(a, b)).alias("r")) for a, b in pairs]
    found = wide.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*").where("r is not null and not isnan(r)")
    limit = found.agg(F.percentile("r", F.lit(percentile)).alias("limit"))
    return found.join(F.broadcast(limit)).where("r >= limit").select("a", "b", "r")


def quality_score(df: DataFrame, spike_k: float = 5.0, frozen_rows: int = 5, zero_rows: int = 5, burst: int = 3, ratio: float = 0.001) -> DataFrame:
    """One row: sensors hit by each check and the score from 100 down. Weights are the fixed values below.

    Repeated samples are counted first, and all else comes from these counts: a row for each sensor and value tells mean,
    spread, distinct values and the last sample that differs; a second pass counts what depends on that; the last samples and
    the bursts of nulls are windows of their own.
    """
    # Most points that a check takes: frozen 25, missing 20, spikes 15, zero 10, dead 10, null bursts 10, duplicate rows 5.
    n, value, filled = F.col("n"), F.col("value"), F.col("value").isNotNull()
    distinct = df.groupBy("sensor", "ts", "value").agg(F.count("*").alias("n"))
    values = distinct.groupBy("sensor", "value").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max("ts").alias("last"))
    stats = values.groupBy("sensor").agg(
        F.sum("n").alias("rows"),
        F.sum("kinds").alias("kinds"),
        F.coalesce(F.sum(F.when(filled, n)), F.lit(0)).alias("samples"),
        F.count("value").alias("unique_values"),
        (F.sum(value * n) / F.sum(F.when(filled, n))).alias("mean"),
        F.max_by("value", F.when(filled, F.struct("last", "value"))).alias("last_value"),
    )
    known = values.join(stats.select("sensor", "mean", "last_value"), "sensor")
    second = known.groupBy("sensor").agg(F.sum((value - F.col("mean")) * (value - F.col("mean")) * n).alias("squares"), F.max(F.when(value != F.col("last_value"), F.col("last"))).alias("other"))
    per = stats.join(second, "sensor").withColumn("std", F.sqrt(F.when(F.col("samples") > 1, F.col("squares") / (F.col("samples") - 1))))
    found = distinct.join(per.select("sensor", "mean", "std", "samples", "last_value", "other"), "sensor").groupBy("sensor").agg(
        F.coalesce(F.sum(F.when((F.col("samples") >= 4) & (F.col("std") >= 1e-9) & (F.abs(value - F.col("mean")) > spike_k * F.col("std")), n)), F.lit(0)).alias("spikes"),
        F.coalesce(F.sum(F.when((value == F.col("last_value")) & (F.col("other").isNull() | (F.col("ts") > F.col("other"))), n)), F.lit(0)).alias("tail"),
    )
    share = F.when(F.col("samples") == 0, 0.0).otherwise(F.col("unique_values") / F.col("samples"))
    one = per.join(found, "sensor").agg(
        F.count("*").alias("sensors"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("tail") >= frozen_rows).alias("frozen"),
        F.count_if(F.col("rows") > F.col("samples")).alias("missing"),
        F.coalesce(F.sum("spikes"), F.lit(0)).alias("spikes"),
        F.count_if(share <= ratio).alias("dead"),
        F.coalesce(F.sum(F.col("rows") - F.col("kinds")), F.lit(0)).alias("duplicates"),
    )
    zero = stuck_at_zero(df, zero_rows).agg(F.count("*").alias("zero"))
    bursts = null_bursts(df, burst).agg(F.count("*").alias("bursts"))
    one = one.join(F.broadcast(zero)).join(F.broadcast(bursts))  # single rows
    per_sensor = lambda c, most: F.least(F.col(c) / F.greatest("sensors", F.lit(1)) * most, F.lit(float(most)))
    of_rows = lambda c: F.col(c) / F.greatest("n_rows", F.lit(1)) * 100
    lost = per_sensor("frozen", 25) + per_sensor("missing", 20) + F.least(of_rows("spikes") * 0.15, F.lit(15.0)) + per_sensor("zero", 10) + per_sensor("dead", 10) + per_sensor("bursts", 10) + F.least(of_rows("duplicates") * 0.5, F.lit(5.0))
    columns = ["sensors", "n_rows", "frozen", "missing", "spikes", "zero", "dead", "bursts", "duplicates"]
    return one.select(*columns, F.round(F.greatest(100 - lost, F.lit(0.0)), 2).alias("score"))


def ingest_report(df: DataFrame, window: str) -> DataFrame:
    """What a load would reject, by reason, and what it would keep. ``df``: (sensor, ts, order)."""
    n = df.groupBy("sensor", "ts").agg(F.count("*").alias("n"))
    newest = n.groupBy("sensor").agg((F.max("ts") - F.expr(f"interval {window}")).alias("_least"))
    rows = n.join(newest, "sensor")
    return rows.agg(
        F.coalesce(F.sum(F.when(F.col("ts").isNull(), F.col("n"))), F.lit(0)).alias("bad_timestamp"),
        F.coalesce(F.sum(F.when(F.col("ts").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_timestamp"),
        F.count_if(F.col("ts") < F.col("_least")).alias("out_of_retention_window"),
        F.count_if(F.col("ts") >= F.col("_least")).alias("kept"),
    )
