"""Values from text. A text that is no such value gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.text import col, text

# Steps of a limit's suffix, and texts of truth values.
SUFFIX = {"k": 1e3, "m": 1e6, "g": 1e9, "b": 1e9, "t": 1e12}
NO_LIMIT = ("n/a", "na", "none", "null", "-", "--", "faulty tag", "faulty")
TRUE, FALSE = ("1", "true", "yes", "y"), ("0", "false", "no", "n")
YEAR_FIRST = ("yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d", "yyyy/M/d")
DAY_FIRST = ("d/M/yyyy H:m:s", "d-M-yyyy H:m:s", "d.M.yyyy H:m:s", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy")
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd")


def number(c: Column | str) -> Column:
    """A number with commas between thousands."""
    return F.replace(text(c), F.lit(","), F.lit("")).try_cast("double")


def numeric_limit(c: Column | str) -> Column:
    """struct(value, reason) of the number that a text begins with, times what a size letter behind it says.

    A blank has neither; a text that stands for no value has the reason ``placeholder``, another without a number
    ``non-numeric:`` and its first 40 characters.
    """
    t = text(c)
    whole = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    shape = r"^([+-]?[0-9]*\.?[0-9]+)\s*([kKmMgGbBtT]?)"
    part = lambda k: F.regexp_extract(F.replace(t, F.lit(","), F.lit("")), shape, k)
    step = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv]), F.lower(part(2)))
    none = F.lower(t).isin(*NO_LIMIT)
    value = F.when(none | (t == ""), None).when(whole, t.try_cast("double")).otherwise(part(1).try_cast("double") * F.coalesce(step, F.lit(1.0)))
    why = F.when((t == "") | value.isNotNull(), None).when(none, "placeholder").otherwise(F.concat(F.lit("non-numeric:"), F.substring(t, 1, 40)))
    return F.struct(value.alias("value"), why.alias("reason"))


def first_number(c: Column | str) -> Column:
    return F.regexp_extract(text(c), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def truth(c: Column | str) -> Column:
    t = F.lower(text(c))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def finite(c: Column | str) -> Column:
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def timestamp(c: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """By the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text(c), F.lit(f)) for f in formats])


def epoch_ms(c: Column | str) -> Column:
    """Milliseconds of a number of seconds or of milliseconds: numbers below ten billion are seconds."""
    x = col(c).cast("long")
    return F.when(x < 10_000_000_000, x * 1000).otherwise(x)


def limit_of_type(c: Column | str, sql_type: str) -> Column:
    """A text as the declared type takes it: numbers with a part where whole ones are due, and unknown truth words, are null."""
    t, kind = text(c), sql_type.lower()
    if kind.startswith(("int", "bigint", "smallint")):
        x = F.replace(t, F.lit(","), F.lit("")).try_cast("double")
        return F.when(x == F.floor(x), x.cast("long"))
    if kind.startswith(("numeric", "decimal", "double", "float", "real")):
        return number(c)
    if kind.startswith("bool"):
        low = F.lower(t)
        return F.when(low.isin("true", "t", "1", "yes"), True).when(low.isin("false", "f", "0", "no"), False)
    if kind.startswith(("timestamp", "date")):
        return timestamp(c)
    return F.nullif(t, F.lit(""))


def series_timestamp(df: DataFrame, column: str, order: str, out: str = "ts") -> DataFrame:
    """``df`` with ``out``: the column's times, all read year first or all day first, as the first filled one (by ``order``) is written."""
    t = text(column)
    first = df.where(t != "").agg(F.min_by(t, order).alias("_first")).select(F.col("_first").rlike("^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}").alias("_iso"))
    read = lambda formats: F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])
    value = F.when(F.col("_iso"), read(YEAR_FIRST)).otherwise(F.coalesce(read(DAY_FIRST), read(YEAR_FIRST)))
    return df.join(F.broadcast(first)).withColumn(out, value).drop("_iso")
