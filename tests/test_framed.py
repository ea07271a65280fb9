"""Framed logs: written, read by time, and only the folders that can hold what is asked for."""

import random

from pyspark.sql import functions as F

from tagwright.sources import framed

DAY = 86_400_000


def test_records_are_found_over_the_edge_of_a_day(spark, tmp_path):
    r = random.Random(14)
    path = str(tmp_path / "log")
    rows = [(r.randrange(3 * DAY, 8 * DAY), f"/e{k}", 200 + k % 3, {"k": str(k)}) for k in range(2000)] + [(5 * DAY + s, "/edge", 500, None) for s in (0, 1, 20_000, 36_999, 37_000)] + [(None, "/none", 1, None)]
    df = spark.createDataFrame(rows, "logged_ms long, endpoint string, status int, context map<string,string>").withColumn("extra", F.lit(1))
    framed.write(df, path, first_second=37)
    for a, b in ((5 * DAY, 5 * DAY + 37_000), (3 * DAY, 8 * DAY), (5 * DAY - 1, 6 * DAY), (9 * DAY, 10 * DAY)):
        got = framed.read(spark, path, a, b)
        assert sorted((x.logged_ms, x.endpoint, x.status, x.context) for x in got.collect()) == sorted(((t, e, s, c) for t, e, s, c in rows if t is not None and a <= t <= b), key=lambda x: x[:3])
    got = framed.read(spark, path, 5 * DAY, 5 * DAY + 1000)
    assert len(got.collect()) >= 2
    scan = next(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x)
    assert "1970-01-05" in scan and "1970-01-06" in scan  # the day and, for batches still open at midnight, the one before
    assert {x.day for x in spark.read.parquet(path).where("day between '1970-01-05' and '1970-01-06'").select(F.col("day").cast("string")).distinct().collect()} == {"1970-01-05", "1970-01-06"}


def test_batches_that_are_cut_off_keep_their_whole_records(spark, tmp_path):
    path = str(tmp_path / "log")
    raw = framed.record(logged_ms=1, endpoint="/é") + framed.record(logged_ms=2) + framed.record(logged_ms=3)[:-2]
    rows = [(0, raw, "1970-01-01"), (0, b"", "1970-01-01"), (0, None, "1970-01-01"), (0, (3).to_bytes(4, "big") + b"{x}" + framed.record(logged_ms=4), "1970-01-01")]
    spark.createDataFrame(rows, "batch_ms long, records binary, day string").write.partitionBy("day").parquet(path)
    assert sorted((x.logged_ms, x.endpoint) for x in framed.read(spark, path, 0, 10).collect()) == [(1, "/é"), (2, None), (4, None)]
