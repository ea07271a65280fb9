"""What the text operators share: written tables that cut lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def pieces(values: pa.Array, most_bytes: int = 4 << 20) -> Iterator[pa.Array]:
    """The rows of a column of texts or lists in turn, in slices of about so many bytes, so that a worker holds the results of one slice."""
    size = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    piece = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:]):
        yield values.slice(a, b - a)


def in_a_row(flat: np.ndarray, size: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these sizes in ``flat`` the picked ones in turn, and their sizes."""
    n = size[picks]
    ends = np.cumsum(n)
    return flat[np.repeat((np.cumsum(size) - size)[picks] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a folder of our own only where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="tagwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that a lost executor costs a read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagwright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB from here on in this session, unless it has a size of its own.

    Spark's 64 MB are held several times over by each task, on both sides of a Python worker, and what the allocators of
    either side once took they keep for the stages that follow.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(4 << 20))


def within(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most so many rows; otherwise as it is, for a join that shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node of ``edges`` (src long, dst long): node, component = the smallest node that it reaches.

    Large-star and small-star rounds in turn: every round replaces each edge by edges to the smallest neighbour, so the
    number of edges never grows past the first round's and the rounds are about the logarithm of the longest path. Each
    round is written to the shared folder. Self loops and nulls are ignored; no edges give no rows.
    """
    both = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, before = staged(both, "edges"), None
    for _ in range(max_rounds):
        # large star: all larger neighbours of a node go to its smallest neighbour (or to itself if it is the smallest)
        way = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = way.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = way.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: all smaller neighbours of a node, and itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), "m").where("u > m").union(least.select("u", "m"))
        now = staged(small.distinct().select("u", F.col("m").alias("v")), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
