"""Queries on samples: ``events`` with the type as sensor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.operators import timeseries as ts
from tagwright.operators.joins import permission_matrix
from tagwright.operators.tables import histogram, keep_last, last_non_blank

TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample a sensor and minute, the last to arrive; values below 5 count as missing."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("sensor"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("value") >= 5, F.col("value")).alias("value"), "event_id")
    return keep_last(e, ["sensor", "ts"], ["event_id"]).select("sensor", "ts", "value", "event_id")


SAMPLES = """s AS (SELECT sensor, ts, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM
(SELECT event_type AS sensor, date_trunc('minute', ts)::TIMESTAMP AS ts, struct_pack(v := CASE WHEN value >= 5 THEN value END) AS value, event_id FROM events) GROUP BY ALL),
t AS (SELECT sensor, ts, value.v AS value, event_id FROM s)"""


def stepped(spark, d):
    """Values in steps, so that sensors repeat themselves and stand at zero."""
    return samples(spark, d).withColumn("value", F.floor(F.col("value") / 40).cast("double"))


STEPPED = SAMPLES + ", u AS (SELECT sensor, ts, floor(value / 40) AS value FROM t)"


def per_user(spark, d):
    """One sensor a user, with few values."""
    return table(spark, d, "events").select(F.col("user_id").alias("sensor"), "ts", F.floor(F.col("value") / 1000).cast("double").alias("value"))


def ts_keep_last_dedup(spark, d):
    return samples(spark, d)


def ts_retention_window(spark, d):
    return ts.retain(table(spark, d, "events").select("event_type", "ts", "event_id"), "event_type", "ts", "7 days")


def ts_spikes(spark, d):
    return ts.spikes(samples(spark, d), 2.0).groupBy("sensor").agg(F.count("*").alias("spike_count"), F.round(F.max("deviation"), 4).alias("largest"))


def ts_gaps(spark, d):
    return ts.intervals(samples(spark, d))


def ts_null_bursts(spark, d):
    return ts.null_bursts(samples(spark, d), 2)


def ts_frozen(spark, d):
    return ts.frozen(stepped(spark, d), 1)


def ts_stuck_at_zero(spark, d):
    return ts.stuck_at_zero(stepped(spark, d), 20)


def ts_dead_sensors(spark, d):
    return ts.dead(per_user(spark, d), 0.02).withColumn("unique_ratio", F.round("unique_ratio", 6))


def daily(spark, d):
    return table(spark, d, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("sensor"), "value")


def ts_pivot(spark, d):
    return ts.pivot(daily(spark, d), TYPES)


def ts_melt(spark, d):
    return ts.melt(ts_pivot(spark, d), "ts", TYPES)


def ts_duplicate_signals(spark, d):
    wide = daily(spark, d).groupBy("ts").pivot("sensor", TYPES).agg(F.sum("value"))
    return ts.duplicate_signals(wide, TYPES, 0.8).withColumn("r", F.round("r", 6))


def ts_quality_score(spark, d):
    return ts.quality_score(samples(spark, d).select("sensor", "ts", "value"), 2.0)


def ts_ingest_rejects(spark, d):
    return ts.ingest_report(table(spark, d, "events").select(F.col("event_type").alias("sensor"), F.when(F.col("event_id") % 50 != 0, F.date_trunc("minute", "ts").cast("timestamp_ntz")).alias("ts")), "7 days")


def ts_daily_histogram(spark, d):
    return histogram(table(spark, d, "events"), "value", ["event_type"])


def ts_latest_per_device(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("latest"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))


def transpose_codes(spark, d):
    rows = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return ts.transpose_codes(rows, ["day"], "event_type", "n", {t: f"n_{t}" for t in TYPES})


def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def json_keys(spark, d):
    return table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).distinct()


def dedup_last_non_null(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return last_non_blank(e, ["user_id", "event_type"], "event_id", ["value", "props"])


def matrix(spark, d):
    e = table(spark, d, "events")
    return permission_matrix(e.select(F.col("user_id").alias("user")).distinct(), e.select(F.col("event_type").alias("feature")).distinct(), e.where("value > 90").select(F.col("user_id").alias("user"), F.col("event_type").alias("feature"))).select("user", F.array_join(F.transform("granted", lambda g: F.when(g, "1").otherwise("0")), "").alias("granted"))


_CASES = lambda what: ", ".join(what.format(t=t) for t in TYPES)

PIVOT = "SELECT date_trunc('day', ts)::TIMESTAMP AS ts, " + _CASES("min(CASE WHEN event_type = '{t}' THEN value END) AS {t}") + " FROM events GROUP BY 1"
_MODE = "p AS (SELECT sensor, date_diff('microsecond', lag(ts) OVER (PARTITION BY sensor ORDER BY ts), ts) AS step FROM t), m AS (SELECT sensor, step, count(*) AS n FROM p WHERE step IS NOT NULL GROUP BY ALL), e AS (SELECT sensor, step AS expected_us FROM m QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY n DESC, step) = 1)"
_STATS = "k AS (SELECT sensor, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM t WHERE value IS NOT NULL GROUP BY 1)"
_SPIKES = "SELECT t.sensor, abs(value - mean) / std AS deviation FROM t JOIN k USING (sensor) WHERE n >= 4 AND abs(value - mean) > 2.0 * std"
_FROZEN = "SELECT sensor, frozen_value, count(*) AS frozen_rows, min(ts) AS since FROM (SELECT *, max(CASE WHEN value <> frozen_value THEN ts END) OVER (PARTITION BY sensor) AS other FROM (SELECT *, last_value(value) OVER (PARTITION BY sensor ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS frozen_value FROM {x} WHERE value IS NOT NULL)) WHERE other IS NULL OR ts > other GROUP BY ALL HAVING count(*) >= {n}"
_ZERO = "SELECT sensor, count(*) FILTER (WHERE value = 0) AS zero_rows FROM (SELECT * FROM {x} WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY ts DESC, value) <= {n}) GROUP BY 1 HAVING zero_rows > 0"
_BURSTS = "SELECT sensor, n AS rows, start FROM (SELECT sensor, b, count(*) AS n, min(ts) AS start FROM (SELECT *, count(value) OVER (PARTITION BY sensor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM t) WHERE value IS NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY n DESC, start) = 1"
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM w" for i, a in enumerate(TYPES) for b in TYPES[i + 1 :])

QUERIES = {
    "ts_keep_last_dedup": (ts_keep_last_dedup, f"WITH {SAMPLES} SELECT * FROM t"),
    "ts_retention_window": (ts_retention_window, "SELECT event_type, ts, event_id FROM events QUALIFY ts >= max(ts) OVER (PARTITION BY event_type) - INTERVAL 7 DAY"),
    "ts_spikes": (ts_spikes, f"WITH {SAMPLES}, {_STATS} SELECT sensor, count(*) AS spike_count, round(max(deviation), 4) AS largest FROM ({_SPIKES}) GROUP BY 1"),
    "ts_gaps": (
        ts_gaps,
        f"WITH {SAMPLES}, {_MODE} SELECT sensor, any_value(expected_us) AS expected_us, sum(CASE WHEN step = 0 THEN n ELSE 0 END)::BIGINT AS duplicate_timestamps, sum(CASE WHEN step <> expected_us THEN n ELSE 0 END)::BIGINT AS irregular_intervals, sum(CASE WHEN step > expected_us THEN n ELSE 0 END)::BIGINT AS gap_count, sum(CASE WHEN step > expected_us THEN n * greatest(step // expected_us - 1, 0) ELSE 0 END)::BIGINT AS missing_slots FROM m JOIN e USING (sensor) GROUP BY 1",
    ),
    "ts_null_bursts": (ts_null_bursts, f"WITH {SAMPLES} SELECT * FROM ({_BURSTS}) WHERE rows >= 2"),
    "ts_frozen": (ts_frozen, f"WITH {STEPPED} " + _FROZEN.format(x="u", n=1)),
    "ts_stuck_at_zero": (ts_stuck_at_zero, f"WITH {STEPPED} SELECT *, CASE WHEN zero_rows >= 20 THEN 'FAIL' ELSE 'WARN' END AS status FROM ({_ZERO.format(x='u', n=20)})"),
    "ts_dead_sensors": (ts_dead_sensors, "SELECT user_id AS sensor, count(DISTINCT floor(value / 1000)) AS unique_values, count(*) AS samples, round(count(DISTINCT floor(value / 1000)) / count(*), 6) AS unique_ratio FROM events GROUP BY 1 HAVING count(DISTINCT floor(value / 1000)) / count(*) <= 0.02"),
    "ts_pivot": (ts_pivot, PIVOT),
    "ts_melt": (ts_melt, f"WITH w AS ({PIVOT}) " + " UNION ALL ".join(f"SELECT ts, '{t}' AS sensor, {t} AS value FROM w" for t in TYPES)),
    "ts_duplicate_signals": (ts_duplicate_signals, "WITH w AS (SELECT date_trunc('day', ts) AS d, " + _CASES("sum(CASE WHEN event_type = '{t}' THEN value END) AS {t}") + f" FROM events GROUP BY 1), p AS ({_PAIRS}) SELECT a, b, round(r, 6) AS r FROM p WHERE r >= (SELECT quantile_cont(r, 0.8) FROM p)"),
    "ts_quality_score": (
        ts_quality_score,
        f"""WITH {SAMPLES}, {_STATS}, c AS (SELECT (SELECT count(DISTINCT sensor) FROM t) AS sensors, (SELECT count(*) FROM t) AS n_rows, (SELECT count(*) FROM ({_FROZEN.format(x="t", n=5)})) AS frozen,
        (SELECT count(DISTINCT sensor) FROM t WHERE value IS NULL) AS missing, (SELECT count(*) FROM ({_SPIKES})) AS spikes, (SELECT count(*) FROM ({_ZERO.format(x="t", n=5)})) AS zero,
        (SELECT count(*) FROM (SELECT sensor FROM t GROUP BY 1 HAVING count(value) = 0 OR count(DISTINCT value) / count(value) <= 0.001)) AS dead, (SELECT count(*) FROM ({_BURSTS}) WHERE rows >= 3) AS bursts,
        (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT sensor, ts, value FROM t)) FROM t) AS duplicates)
        SELECT *, round(greatest(100 - least(frozen / sensors * 25, 25) - least(missing / sensors * 20, 20) - least(spikes / n_rows * 100 * 0.15, 15) - least(zero / sensors * 10, 10) - least(dead / sensors * 10, 10) - least(bursts / sensors * 10, 10) - least(duplicates / n_rows * 100 * 0.5, 5), 0.0), 2) AS score FROM c""",
    ),
    "ts_ingest_rejects": (
        ts_ingest_rejects,
        "WITH x AS (SELECT event_type AS sensor, CASE WHEN event_id % 50 <> 0 THEN date_trunc('minute', ts) END AS ts FROM events), g AS (SELECT DISTINCT sensor, ts FROM x WHERE ts IS NOT NULL), o AS (SELECT *, max(ts) OVER (PARTITION BY sensor) - INTERVAL 7 DAY AS low FROM g) SELECT (SELECT count(*) FROM x WHERE ts IS NULL) AS bad_timestamp, (SELECT count(*) FROM x WHERE ts IS NOT NULL) - (SELECT count(*) FROM g) AS duplicate_timestamp, (SELECT count(*) FROM o WHERE ts < low) AS out_of_retention_window, (SELECT count(*) FROM o WHERE ts >= low) AS kept",
    ),
    "ts_daily_histogram": (ts_daily_histogram, "WITH s AS (SELECT min(value) AS low, max(value) AS high FROM events) SELECT least(47, floor((value - low) / ((high - low) / 48)))::INTEGER AS bucket, event_type, count(*) AS n FROM events, s GROUP BY 1, 2"),
    "ts_latest_per_device": (ts_latest_per_device, "SELECT user_id, max(ts) AS latest, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY 1"),
    "transpose_codes": (transpose_codes, "SELECT ts::DATE AS day, " + _CASES("nullif(count(*) FILTER (WHERE event_type = '{t}'), 0) AS n_{t}") + " FROM events GROUP BY 1"),
    "json_props_extract": (json_props_extract, "SELECT event_id, props ->> '$.k' AS k FROM events"),
    "json_keys": (json_keys, "SELECT DISTINCT event_type, unnest(json_keys(props)) AS key FROM events"),
    "dedup_last_non_null": (dedup_last_non_null, "SELECT user_id, event_type, arg_max(value, event_id) FILTER (WHERE value >= 5) AS value, arg_max(props, event_id) AS props FROM events GROUP BY ALL"),
    "permission_matrix": (
        matrix,
        'WITH g AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90) SELECT u.user_id AS "user", string_agg(CASE WHEN g.user_id IS NULL THEN \'0\' ELSE \'1\' END, \'\' ORDER BY f.event_type) AS granted FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) f LEFT JOIN g ON g.user_id = u.user_id AND g.event_type = f.event_type GROUP BY 1',
    ),
}
