"""Consecutive numbers over a whole table, without a task that sorts it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwright.operators.graph import cut

ROW_BITS = 33  # of monotonically_increasing_id: the place within a partition


def numbered_whole(df: DataFrame, order: list, out: str = "uid", start: int = 1) -> DataFrame:
    """``df`` with ``out``: ``start``, ``start + 1``, ... in the order of ``order`` (names or columns); ties in no set order.

    Rows are sorted by ranges, each partition on its own, and kept there by a checkpoint; a partition's numbers begin after
    the rows of all before it. Only the partitions' sizes, a row for each, meet in one task. An empty table stays empty; a column
    named ``out`` is replaced.
    """
    spot, shift = "_spot", F.shiftright("_spot", ROW_BITS)
    kept = [c for c in df.columns if c != out]
    placed = cut(df.select(*kept).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(spot, F.monotonically_increasing_id()))
    sizes = placed.groupBy(shift.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_part", (before + start).alias("_begin"))
    numbered = placed.withColumn("_part", shift).join(F.broadcast(begins), "_part")  # a row for each partition
    return numbered.select(*kept, (F.col("_begin") + F.col(spot).bitwiseAND((1 << ROW_BITS) - 1)).alias(out))
