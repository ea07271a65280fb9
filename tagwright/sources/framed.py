"""Logs in batches of framed records, in folders of days: written by the minute, read by time.

A batch lies in the folder of the day it began. Its records may be as much as BATCH_S later, so some of a day's first
records lie in the folder of the day before.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How long a batch is open, and the bytes that give a record's length.
BATCH_S, LENGTH = 60, 4
PARTS = 8  # batches of one minute, so that a busy minute is no single row
RECORD = "logged_ms long, endpoint string, method string, status int, ok boolean, error string, latency_ms double, context map<string,string>"


def write(df: DataFrame, path: str, first_second: int = 0) -> None:
    """Append records (logged_ms, and what RECORD has else; more columns are not written) as batches that begin at ``first_second`` of each minute.

    A record is its JSON behind its length. Rows without a time are none.
    """
    names = [c.split(" ")[0] for c in RECORD.replace("map<string,string>", "map").split(", ")]
    rows = df.where(F.col("logged_ms").isNotNull()).select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names])
    at = F.col("logged_ms") - F.pmod(F.col("logged_ms") - first_second * 1000, F.lit(BATCH_S * 1000))
    text = F.encode(F.to_json(F.struct(*names)), "UTF-8")
    frame = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * LENGTH, "0")), text)
    rows = rows.select(at.alias("batch_ms"), F.pmod(F.xxhash64("logged_ms", "endpoint"), F.lit(PARTS)).alias("part"), frame.alias("frame"))
    batches = rows.groupBy("batch_ms", "part").agg(F.expr("listagg(frame)").alias("records"))
    batches.withColumn("day", F.date_format(F.timestamp_millis("batch_ms"), "yyyy-MM-dd")).drop("part").write.mode("append").partitionBy("day").parquet(path)


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of framed records; what a batch that was cut off has behind its last whole record is no record."""
    for batch in batches:
        texts = []
        for raw in batch.column(0).to_pylist():
            at = 0
            while at + LENGTH <= len(raw or b""):
                n = int.from_bytes(raw[at : at + LENGTH], "big")
                own = raw[at + LENGTH : at + LENGTH + n]
                if len(own) == n:
                    texts.append(own.decode("utf-8", "replace"))
                at += LENGTH + n
        yield pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})


def read(spark: SparkSession, path: str, start_ms: int, end_ms: int) -> DataFrame:
    """RECORD columns of the records from ``start_ms`` to ``end_ms``, both included, whichever batch they lie in.

    Only folders of days, and in these only batches, that can hold such records are read. Records that are no JSON are
    none.
    """
    day = lambda ms: datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc).strftime("%Y-%m-%d")
    batches = spark.read.schema("batch_ms long, records binary, day string").parquet(path)
    batches = batches.where(F.col("day").between(day(start_ms - BATCH_S * 1000), day(end_ms)) & F.col("batch_ms").between(start_ms - BATCH_S * 1000, end_ms))
    rows = batches.select("records").mapInArrow(decoded, "text string").select(F.from_json("text", RECORD).alias("r")).select("r.*")
    return rows.where(F.col("logged_ms").between(start_ms, end_ms))


def record(**fields) -> bytes:
    """One framed record, for a log's writer or a test."""
    own = json.dumps(fields).encode()
    return len(own).to_bytes(LENGTH, "big") + own
