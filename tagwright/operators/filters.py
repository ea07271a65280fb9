"""Which rows: lists of ids and files, times, properties, pages, first rows, counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.coerce import epoch_ms
from tagwright.functions.nested import as_map
from tagwright.functions.text import basename, is_blank, text

# Milliseconds of units of time.
UNITS = {"ms": 1, "millisecond": 1, "s": 1000, "second": 1000, "m": 60_000, "minute": 60_000, "h": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000}


def relative_ms(period: str) -> int:
    """Milliseconds of ``15m``, ``10 minutes`` or ``last 2 hours``."""
    found = re.match(r"^(?:last )?\s*(\d+)\s*(ms|millisecond|s|second|m|minute|h|hour|d|day)s?$", period.strip().lower())
    if not found:
        raise ValueError(f"no period of time: {period}")
    return int(found[1]) * UNITS[found[2]]


def in_batch(df: DataFrame, column: str, ids: str | list) -> DataFrame:
    """Rows whose id is one of a list, or of a text with commas; no list: all rows."""
    wanted = [str(x).strip() for x in (ids.split(",") if isinstance(ids, str) else ids or []) if str(x).strip()]
    return df.where(text(column).isin(*wanted)) if wanted else df


def file_name(c: str):
    """A file's name without folders, extension, case and separators."""
    return F.regexp_replace(F.lower(F.regexp_replace(basename(c), r"\.[A-Za-z0-9]{1,5}$", "")), "[^a-z0-9]+", "")


def in_files(df: DataFrame, column: str, files: DataFrame, name: str) -> DataFrame:
    """Rows of the files that a table names; if it has no such column, all."""
    if column not in df.columns:
        return df
    wanted = files.select(file_name(name).alias("_f")).where("_f <> ''")
    return df.join(wanted, file_name(column) == F.col("_f"), "left_semi")


def between(df: DataFrame, column: str, start_ms: int, end_ms: int) -> DataFrame:
    """Rows of a time in milliseconds or in seconds between two times, both included."""
    return df.where(F.col(column).between(start_ms, end_ms) | F.col(column).between(start_ms // 1000, end_ms // 1000))


def since(df: DataFrame, column: str, period: str) -> DataFrame:
    """Rows of the last period before the newest row."""
    ms = epoch_ms(F.col(column))
    newest = df.agg(F.max(ms).alias("_newest"))
    return df.join(F.broadcast(newest), ms > F.col("_newest") - relative_ms(period)).drop("_newest")


def with_property(df: DataFrame, column: str, key: str, part: str) -> DataFrame:
    """Rows whose JSON property has a text in it, in any case."""
    return df.where(F.contains(F.lower(F.try_element_at(as_map(column), F.lit(key))), F.lit(part.lower())))


def meaningful(df: DataFrame) -> DataFrame:
    """Without columns that are null everywhere and rows that are blank everywhere. One pass tells which columns are."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if n[c]]
    some = F.lit(False)
    for c in kept:
        some = some | ~is_blank(c)
    return df.select(*kept).where(some)


def without_types(df: DataFrame, column: str, excluded: list[str]) -> DataFrame:
    return df.where(~F.lower(text(column)).isin(*[x.strip().lower() for x in excluded]))


def for_review(df: DataFrame, confidence: str, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows that are sure enough, and those that a person should see."""
    low = F.coalesce(F.col(confidence) < least, F.lit(True))
    return df.where(~low), df.where(low)


def log_rows(df: DataFrame, level: str | None = None, part: str | None = None) -> DataFrame:
    out = df if level is None else df.where(F.upper("level") == level.upper())
    return out if part is None else out.where(F.contains(F.lower("message"), F.lit(part.lower())))


def numbered_page(df: DataFrame, order: list[str], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """A page (from 1) of the rows in order, and one row (total, total_pages, page)."""
    if number < 1 or not 1 <= size <= 10_000:
        raise ValueError("page from 1, size 1 to 10000")
    total = df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).alias("total_pages"), F.lit(number).cast("long").alias("page"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), total


def latest(df: DataFrame, column: str, most: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), *ties).limit(most)


def emptiest(df: DataFrame, most: int = 10) -> DataFrame:
    """The columns with the largest share of nulls. One pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.count_if(F.col(c).isNull()) / F.count("*"), 6).alias("null_share")) for c in df.columns])
    return df.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*").orderBy(F.desc_nulls_last("null_share"), "column").limit(most)


def first_violations(df: DataFrame, by: str, value: str, bad, most: int = 5) -> DataFrame:
    """For each group the number of bad rows and its first distinct bad values, in order. A group leaves no more than ``most`` of a task's values to be sorted."""
    rows = df.where(bad).groupBy(by, value).agg(F.count("*").alias("_n"))
    first = rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(value))).where(F.col("_place") <= most)
    samples = first.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("samples"))
    return rows.groupBy(by).agg(F.sum("_n").alias("n")).join(samples, by)


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n of several columns in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))


def preview(tables: dict[str, DataFrame], column: str, value: str) -> DataFrame:
    """How many rows of each table a purge by ``column`` would take."""
    parts = [df.where(F.col(column) == value).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items() if column in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
