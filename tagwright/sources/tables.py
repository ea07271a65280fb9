"""Tables in files: resolving a name, reading, replacing, and lines of logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a pipeline's log line looks like.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\S*\s+\[(\w+)\]\s+(.*)$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as it is; CSV with a header, every column as text, blanks kept; names without blanks around them."""
    if ".csv" in path:
        df = spark.read.option("header", True).csv(path).fillna("")
    else:
        df = spark.read.parquet(path)
    return df.toDF(*[c.strip() for c in df.columns])


def resolve(spark: SparkSession, folder: str, name: str) -> str:
    """Path of a table: ``name.parquet``, ``name.csv``, then ``name_*``, then ``name*`` in any folder below, Parquet before CSV; of several the newest."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest = lambda found: max(found, key=lambda f: f.getModificationTime()).getPath().toString()
    for pattern in (f"{name}.parquet", f"{name}.csv", f"{name}_*.parquet", f"{name}_*.csv"):
        if found := list(fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern)) or []):
            return newest(found)
    level, below = [root], {"parquet": [], "csv": []}
    while level and not any(below.values()):  # a level of folders at a time
        inside = [f for p in level for f in fs.listStatus(p)]
        for f in inside:
            kind = f.getPath().getName().rpartition(".")[2]
            if f.getPath().getName().startswith(name) and kind in below:
                below[kind].append(f)
        level = [f.getPath() for f in inside if f.isDirectory() and f.getPath().getName().rpartition(".")[2] not in below]
    for found in below.values():
        if found:
            return newest(found)
    raise FileNotFoundError(f"{folder}/{name}")


def files(spark: SparkSession, folder: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """Files below a folder: path, length, modificationTime, by name and size; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")
    return df if most_bytes is None else df.where(F.col("length") <= most_bytes)


def replace(df: DataFrame, table: str, partition_by: list[str] = ()) -> None:
    """``df`` as the stored table ``table``, which ``df`` itself may have read.

    ``table`` is a view on its newest version, a table of its own: the new version is written whole, then the view is put on it
    in one step, then older versions go. A crash leaves the old table or the new one. One writer at a time.
    """
    spark, version = df.sparkSession, f"{table}_v{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*partition_by).format("parquet").saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {version}")
    short = table.rpartition(".")[2]
    for old in spark.catalog.listTables(table.rpartition(".")[0] or None):
        if old.name.startswith(f"{short}_v") and old.name != version.rpartition(".")[2]:
            spark.sql(f"DROP TABLE IF EXISTS {old.name if '.' not in table else table.rpartition('.')[0] + '.' + old.name}")


def log_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Time, level and message of log lines; lines of another shape have none of these."""
    part = lambda k: F.nullif(F.regexp_extract(line, LOG_LINE, k), F.lit(""))
    return lines.withColumns({"logged_at": part(1), "level": part(2), "message": part(3)})
