"""Streams of samples and events. State is bounded by watermarks; restarts go on from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def samples(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once_each(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten after ``late``. Also replays of one request by its idempotency key."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def window_quality(stream: DataFrame, sensor: str, ts: str, value: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Samples, nulls and range of each sensor and window, once the watermark has passed it."""
    by = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(by.alias("w"), sensor).agg(F.count("*").alias("samples"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias("low"), F.max(value).alias("high"))


def log_batches(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", every: str | None = "60 seconds") -> StreamingQuery:
    """API log records to folders of days, a batch a minute; without ``every`` all that is there now, then an end."""
    dated = stream.withColumn("day", F.to_date(ts))
    return dated.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start(path)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now in batches through ``apply`` (a merge into a stored table, for example), then an end."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
