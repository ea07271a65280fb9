"""Queries of the series quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright.operators import reports
from tagwright.plans import series as s


def raw(spark, d):
    """Samples a quarter of an hour apart at best, some of them twice, values below 5 missing."""
    e = s.table(spark, d, "events").select(F.col("event_type").alias("sensor"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("value") >= 5, F.floor(F.col("value") / 10).cast("double")).alias("value"), "event_id")
    return e.where("event_id % 5 > 0").select("sensor", "ts", "value")


RAW = "t AS (SELECT event_type AS sensor, date_trunc('hour', ts)::TIMESTAMP AS ts, CASE WHEN value >= 5 THEN floor(value / 10)::DOUBLE END AS value FROM events WHERE event_id % 5 > 0)"
_K = "k AS (SELECT sensor, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM t WHERE value IS NOT NULL GROUP BY 1)"
_SPIKES = "p AS (SELECT t.sensor, ts, value, abs(value - mean) / std AS deviation FROM t JOIN k USING (sensor) WHERE n >= 4 AND std >= 1e-9 AND abs(value - mean) > 1.5 * std)"
_STEPS = "m AS (SELECT sensor, lag(ts) OVER (PARTITION BY sensor ORDER BY ts) AS after, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY sensor ORDER BY ts)) AS step FROM t), e AS (SELECT sensor, arg_min(step, (-n, step)) AS usual FROM (SELECT sensor, step, count(*) AS n FROM m WHERE step IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


def ts_overview(spark, d):
    return reports.overview(raw(spark, d))


def ts_missing_values(spark, d):
    return reports.missing_values(raw(spark, d)).withColumn("null_times", F.array_join(F.col("null_times").cast("array<string>"), ","))


def ts_duplicate_rows(spark, d):
    return reports.duplicate_rows(raw(spark, d))


def ts_first_spikes(spark, d):
    out = reports.first_spikes(raw(spark, d), 1.5)
    return out.select("sensor", "spike_count", F.posexplode("spikes").alias("place", "x")).select("sensor", "spike_count", F.col("place").cast("long").alias("place"), "x.ts", "x.value", "x.deviation")


def ts_first_gaps(spark, d):
    out = reports.first_gaps(raw(spark, d), 7).select("sensor", F.posexplode("gaps").alias("place", "x"))
    return out.select("sensor", F.col("place").cast("long").alias("place"), "x.after", "x.seconds")


def ts_checks_summary(spark, d):
    pairs = s.table(spark, d, "nation").where("n_nationkey < 2").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    return reports.checks_summary(raw(spark, d), 1.5, frozen_rows=2, burst=2, pairs=pairs)


SUMMARY = f"""WITH {RAW}, {_K}, {_SPIKES}, {_STEPS},
n AS (SELECT count(DISTINCT sensor) AS sensors, count(*) AS rows FROM t),
l AS (SELECT sensor, arg_max(value, (ts, value)) AS last FROM t WHERE value IS NOT NULL GROUP BY 1),
o AS (SELECT t.sensor, any_value(last) AS last, max(CASE WHEN value <> last THEN ts END) AS other FROM t JOIN l USING (sensor) WHERE value IS NOT NULL GROUP BY 1),
f AS (SELECT sensor FROM t JOIN o USING (sensor) WHERE value IS NOT NULL AND (other IS NULL OR ts > other) GROUP BY 1 HAVING count(*) >= 2),
z AS (SELECT sensor FROM (SELECT * FROM t WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY ts DESC, value) <= 5) GROUP BY 1 HAVING count(*) FILTER (value = 0) > 0),
d AS (SELECT sensor FROM t GROUP BY 1 HAVING count(value) = 0 OR count(DISTINCT value) / count(value) <= 0.001),
u AS (SELECT count(*) - count(DISTINCT (sensor, ts, value)) AS n FROM t),
c AS (SELECT 'missing_values' AS "check", (SELECT count(DISTINCT sensor) FROM t WHERE value IS NULL) AS affected, 0 AS "count"
 UNION ALL SELECT 'frozen_signals', (SELECT count(*) FROM f), 0 UNION ALL SELECT 'stuck_at_zero', (SELECT count(*) FROM z), 0 UNION ALL SELECT 'dead_sensors', (SELECT count(*) FROM d), 0
 UNION ALL SELECT 'spikes', (SELECT count(DISTINCT sensor) FROM p), (SELECT count(*) FROM p) UNION ALL SELECT 'duplicate_rows', n, n FROM u UNION ALL SELECT 'duplicate_signals', 4, 2
 UNION ALL SELECT 'timestamp_gaps', count(DISTINCT sensor), coalesce(sum(CASE WHEN usual > 0 THEN greatest(step // nullif(usual, 0) - 1, 0) END), 0) FROM m JOIN e USING (sensor) WHERE step > usual)
SELECT "check", affected, CASE WHEN "check" = 'duplicate_rows' THEN rows ELSE sensors END AS total, round(affected / CASE WHEN "check" = 'duplicate_rows' THEN rows ELSE sensors END * 100, 2) AS affected_pct, "count"::BIGINT AS "count" FROM c, n"""


def ts_checks_summary_ordered(spark, d):
    """The summary without bursts of nulls, which depend on the order of samples of one time."""
    return ts_checks_summary(spark, d).where("check <> 'null_bursts'")


QUERIES = {
    "ts_overview": (ts_overview, f"WITH {RAW} SELECT count(*) AS n_rows, count(DISTINCT sensor) AS sensors, 0 AS null_times, min(ts) AS first, max(ts) AS last, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000, 2) AS minutes FROM t"),
    "ts_missing_values": (ts_missing_values, f"WITH {RAW}, r AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts) AS k FROM t WHERE value IS NULL), n AS (SELECT sensor, count(*) AS n FROM t GROUP BY 1) SELECT sensor, count(*) AS missing, round(count(*) / any_value(n) * 100, 2) AS missing_pct, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY k) FILTER (k <= 5) AS null_times FROM r JOIN n USING (sensor) GROUP BY 1"),
    "ts_duplicate_rows": (ts_duplicate_rows, f"WITH {RAW}, g AS (SELECT sensor, ts, value, count(*) AS n FROM t GROUP BY ALL), h AS (SELECT sensor, (sum(n) - count(*))::BIGINT AS full_duplicates, (sum(n) - count(DISTINCT ts))::BIGINT AS ts_duplicates FROM g GROUP BY 1) SELECT *, CASE WHEN full_duplicates > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM h"),
    "ts_first_spikes": (ts_first_spikes, f"WITH {RAW}, {_K}, {_SPIKES}, r AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts, value) - 1 AS place, count(*) OVER (PARTITION BY sensor) AS spike_count FROM p) SELECT sensor, spike_count, place, ts, value, round(deviation, 2) AS deviation FROM r WHERE place < 10"),
    "ts_first_gaps": (ts_first_gaps, f"WITH {RAW}, {_STEPS}, r AS (SELECT sensor, row_number() OVER (PARTITION BY sensor ORDER BY after) - 1 AS place, after, step / 1000000 AS seconds FROM m JOIN e USING (sensor) WHERE step > usual) SELECT * FROM r WHERE place < 7"),
    "ts_checks_summary": (ts_checks_summary_ordered, SUMMARY),
}
