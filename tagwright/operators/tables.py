"""Columns and rows of tables: renames, declared schemas, dedup, collapse, consolidation.

Order matters in all that keeps a first or last row; it is always a column, never the order of files. Where one aggregate can
answer, rows are combined before the shuffle (``min_by`` and ``max_by``) and no window sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.coerce import number
from tagwright.functions.text import composite_key, is_blank, measurement_name, non_blank, normalize_asset, text


def header_key(name: str) -> str:
    return "".join(c for c in name.upper() if c.isalnum())


def rename(df: DataFrame, targets: dict[str, str], priority: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns by a map of headers to names that ignores case and separators.

    Of several headers with one target the first in ``priority`` wins, else the first column; the others keep their names.
    """
    by_key, taken = {header_key(k): v for k, v in targets.items()}, {}
    for c in df.columns:
        if t := by_key.get(header_key(c)):
            taken.setdefault(t, []).append(c)
    order = {t: [header_key(x) for x in xs] for t, xs in (priority or {}).items()}
    rank = lambda t, c: order[t].index(header_key(c)) if header_key(c) in order.get(t, []) else len(order.get(t, []))
    return df.withColumnsRenamed({min(cs, key=lambda c: rank(t, c)): t for t, cs in taken.items() if t not in df.columns or t in cs})


def normalize_columns(df: DataFrame) -> DataFrame:
    """Names in lower case with underscores; blank ones are numbered by place, repeated ones by occurrence."""
    seen: dict[str, int] = {}
    out = []
    for k, c in enumerate(df.columns, 1):
        n = "_".join("".join(x if x.isalnum() else " " for x in c.lower()).split()) or f"column_{k}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*out)


def conform(df: DataFrame, schema: dict[str, str], keep_extra: bool = False) -> DataFrame:
    """Declared columns in order, missing ones null; others go, or follow with ``keep_extra``. A value that does not cast is null."""
    declared = [(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()]
    return df.select(*declared, *[c for c in df.columns if keep_extra and c not in schema])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` of each key; other columns decide ties. Null keys are a key."""
    return _extreme(df, keys, order, F.max, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _extreme(df, keys, order, F.min, F.min_by)


def _extreme(df: DataFrame, keys: list[str], order: list[str], pick, pick_by) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    maps = [c for c in rest if df.schema[c].dataType.typeName() == "map"]
    first = [c for c in order if c in rest]
    place = F.struct(*first, *[c for c in rest if c not in first and c not in maps])
    # the place holds the whole row, so it moves once; maps have no order and go beside it
    row = pick_by(F.struct(*rest), place) if maps or not rest else pick(place)
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def last_non_blank(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row a key, each column with its last value that is not null (for text: not blank)."""
    kinds = dict(df.dtypes)
    has = lambda c: ~is_blank(c) if kinds[c] == "string" else F.col(c).isNotNull()
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(has(c), F.struct(order, c))).alias(c) for c in columns])


def collapse(df: DataFrame, keys: list[str], additive: list[str], order: str) -> DataFrame:
    """Rows that a join fanned out, one a key: ``additive`` columns summed (text with commas too), others their first value that is not null."""
    kinds, others = dict(df.dtypes), [c for c in df.columns if c not in [*keys, *additive]]
    value = lambda c: number(c) if kinds[c] == "string" else F.col(c)
    return df.groupBy(*keys).agg(
        *[F.sum(value(c)).alias(c) for c in additive],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in others],
    )


def consolidate(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables in order of trust as one: per upper-cased key and column the first source's value that is not blank; rows without any key go."""
    parts = [s.withColumns({"_source": F.lit(k)} | {c: F.nullif(normalize_asset(c), F.lit("")) for c in keys}) for k, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    kinds = dict(rows.dtypes)
    value = lambda c: non_blank(c) if kinds[c] == "string" else F.col(c)
    others = [c for c in rows.columns if c not in [*keys, "_source"]]
    named = rows.where(F.coalesce(*keys).isNotNull())
    return named.groupBy(*keys).agg(*[F.min_by(value(c), F.when(value(c).isNotNull(), F.struct("_source", value(c)))).alias(c) for c in others])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "occurrence") -> DataFrame:
    """Place of each row among those of its key, from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def suffixed(df: DataFrame, name: str, order: list[str], mark: str = "#") -> DataFrame:
    """Repeated names get a mark and their number from the second on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit(mark), n)).otherwise(F.col(name)))


def search(df: DataFrame, wanted: str, max_cols: int | None = None) -> DataFrame:
    """Rows with the text in any text column, case ignored, or in the first ``max_cols``."""
    texts = [c for c, t in df.dtypes if t == "string"][:max_cols]
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted.lower())), F.lit(False))
    return df.where(hit)


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 10_000 or offset < 0:
        raise ValueError("limit 1 to 10000, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def histogram(df: DataFrame, value: str, by: list[str], buckets: int = 48) -> DataFrame:
    """Counts in buckets of equal width over the span of ``value``; the last one is closed. One pass for the span, one to count."""
    span = df.agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    rows = df.select(F.col(value).cast("double").alias("_v"), *by).where("_v is not null").join(F.broadcast(span))
    width = (F.col("_high") - F.col("_low")) / buckets
    bucket = F.when(width == 0, 0).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_low")) / width).cast("int")))
    return rows.withColumn("bucket", bucket).groupBy("bucket", *by).agg(F.count("*").alias("n"))


def rollup(df: DataFrame, parent: str, leaf: str) -> DataFrame:
    """Counts of leaves and of their parents (leaf null)."""
    plain = df.select(F.coalesce(non_blank(parent), F.lit("uncategorised")).alias(parent), F.coalesce(non_blank(leaf), F.lit("uncategorised")).alias(leaf))
    return plain.rollup(parent, leaf).agg(F.count("*").alias("n")).where(F.col(parent).isNotNull())


def stable_keys(df: DataFrame, base: str, out: str = "stable_key") -> DataFrame:
    """The base where it is unique, else the base and a digest of all the row's values, so that equal rows keep one key."""
    values = F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), text(c)) for c in sorted(df.columns)])
    n = df.groupBy(F.col(base).alias("_base")).agg(F.count("*").alias("_n"))
    digest = F.concat(F.col(base), F.lit("#"), F.substring(F.sha2(values, 256), 1, 32))  # 128 bits: 32 met among the rows of one base
    return df.join(n, F.col(base).eqNullSafe(F.col("_base")), "left").withColumn(out, F.when(F.col("_n") > 1, digest).otherwise(F.col(base))).drop("_base", "_n")


def key(*columns: Column | str) -> Column:
    return composite_key(*columns)


def unique_measurements(df: DataFrame, name: str, out: str = "measurement") -> DataFrame:
    """``df`` with a store's name for each raw name; raw names that would share one, and those with nothing left, get a mark of their own text."""
    plain, raw = measurement_name(name), F.coalesce(F.col(name), F.lit("None"))
    mark = F.substring(F.sha1(raw), 1, 4)
    sure = F.when(plain == raw, plain).when(plain == "", F.concat(F.lit("m_"), mark)).otherwise(F.concat(plain, F.lit("_"), mark))
    named = df.withColumn("_plain", F.when(plain == "", sure).otherwise(plain))
    n = named.groupBy("_plain").agg(F.count("*").alias("_n"))
    return named.join(n, "_plain").withColumn(out, F.when(F.col("_n") > 1, sure).otherwise(F.col("_plain"))).drop("_plain", "_n")
