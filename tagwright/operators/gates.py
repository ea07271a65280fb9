"""Gates on staged files and on the model: each check is one pass and gives rows with a severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.coerce import timestamp
from tagwright.functions.text import is_blank


def natural_key(df: DataFrame, keys: list[str], most_null: float = 0.02) -> DataFrame:
    """Rows, null keys and rows with a repeated key, with BLOCK, WARN or PASS."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.when(~null & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicate_rows"))
    status = F.when(F.col("null_keys") / F.col("n_rows") > most_null, "BLOCK").when(F.col("duplicate_rows") > 0, "WARN").otherwise("PASS")
    return g.withColumn("status", status)


def type_conformance(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """For each declared column (date or numeric): values, values that do not parse, their share in percent."""
    cells = []
    for c, kind in kinds.items():
        filled = ~is_blank(c)
        bad = filled & (timestamp(c) if kind == "date" else F.trim(F.col(c)).try_cast("double")).isNull()
        cells.append(F.struct(F.lit(c).alias("column"), F.count_if(filled).alias("filled"), F.count_if(bad).alias("bad")))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*").withColumn("bad_pct", F.round(F.when(F.col("filled") > 0, F.col("bad") / F.col("filled") * 100).otherwise(0.0), 2))


def basics(df: DataFrame) -> DataFrame:
    """For each column: null or blank values and their share in percent. One pass."""
    missing = lambda c, t: is_blank(c) if t == "string" else F.col(c).isNull()
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(missing(c, t)).alias("missing"), F.count("*").alias("n_rows")) for c, t in df.dtypes]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*").withColumn("missing_pct", F.round(F.when(F.col("n_rows") > 0, F.col("missing") / F.col("n_rows") * 100).otherwise(0.0), 2))


def references(child: DataFrame, key: str, parent: DataFrame, parent_key: str, most: float = 50.0) -> DataFrame:
    """Rows with a reference, those that meet no parent, share in percent, status."""
    n = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    ids = parent.select(F.col(parent_key).alias("_id")).distinct()
    g = n.join(ids, F.col(key) == F.col("_id"), "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("referring"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("n"))), F.lit(0)).alias("unresolved"))
    pct = F.round(F.when(F.col("referring") > 0, F.col("unresolved") / F.col("referring") * 100).otherwise(0.0), 2)
    return g.withColumn("unresolved_pct", pct).withColumn("status", F.when(F.col("unresolved_pct") > most, "WARN").otherwise("PASS"))


def drift(now: DataFrame, before: DataFrame, most: float = 0.5) -> DataFrame:
    """Row counts (name, n) of two uploads: change as a share, WARN above ``most``."""
    both = before.select("name", F.col("n").alias("previous")).join(now, "name", "full")
    change = F.when(F.col("previous") > 0, F.abs(F.coalesce("n", F.lit(0)) - F.col("previous")) / F.col("previous"))
    return both.withColumn("change", F.round(change, 4)).withColumn("status", F.when(F.col("change") > most, "WARN").otherwise("PASS"))


def worst(severity: Column) -> Column:
    """BLOCKED, WARNINGS or PASSED of many checks."""
    return F.when(F.max(severity == "BLOCK"), "BLOCKED").when(F.max(severity == "WARN"), "WARNINGS").otherwise("PASSED")


def headers(df: DataFrame, expected: list[str]) -> DataFrame:
    """Columns that are missing (BLOCK if any) and columns more than expected."""
    missing, extra = [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]
    status = "BLOCK" if missing else "PASS"
    return df.sparkSession.createDataFrame([(",".join(missing), ",".join(extra), status)], "missing string, extra string, status string")


def contract(df: DataFrame, name: str, required: list[str], most_null: float = 1.0) -> DataFrame:
    """dataset, n_rows, problems, status: required columns that are missing or null at or above the limit, no rows, no contract. One pass."""
    present = [c for c in required if c in df.columns]
    missing = [c for c in required if c not in df.columns]
    n = F.count("*")
    shares = [F.when((n > 0) & (F.count_if(F.col(c).isNull()) / n >= most_null), F.concat(F.lit(f"{c} is "), F.round(F.count_if(F.col(c).isNull()) / n * 100).cast("int"), F.lit(f"% null, at or over the {round(most_null * 100)}% limit"))) for c in present]
    fixed = [F.lit(f"missing required columns: {', '.join(missing)}")] * bool(missing)
    empty = F.when(n == 0, F.lit("produced 0 rows"))
    none = [F.when(n > 0, F.lit("no contract for this dataset, so nothing was checked"))] * (not required)
    problems = F.filter(F.array(*fixed, empty, *shares, *none), lambda x: x.isNotNull())
    return df.agg(n.alias("n_rows"), F.array_join(problems, "; ").alias("problems")).select(F.lit(name).alias("dataset"), "n_rows", "problems", F.when(F.col("problems") == "", "PASS").otherwise("FAIL").alias("status"))


def repeated_relationships(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Relationships that stand more than once, rows beyond the first, and the status."""
    g = edges.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    out = g.agg(F.count("*").alias("relationships"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))
    return out.withColumn("status", F.when(F.col("extra_rows") > 0, "WARN").otherwise("PASS"))


def coverage(tables: dict[str, DataFrame], declared: dict[str, list[str]]) -> DataFrame:
    """For each declared table: declared columns, those it has, their share in percent."""
    rows = [(t, len(cs), len([c for c in cs if t in tables and c in tables[t].columns])) for t, cs in declared.items()]
    out = next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, declared long, present long")
    return out.withColumn("coverage_pct", F.round(F.when(F.col("declared") > 0, F.col("present") / F.col("declared") * 100).otherwise(0.0), 2))


def metadata_report(described: DataFrame, stored: DataFrame, tag: str) -> DataFrame:
    """tag, state of every tag that is described without samples (missing) or has samples without a description (extra)."""
    a, b = described.select(tag).distinct(), stored.select(tag).distinct()
    return a.join(b, tag, "left_anti").withColumn("state", F.lit("missing")).union(b.join(a, tag, "left_anti").withColumn("state", F.lit("extra")))


def connector_states(files: DataFrame, keys: list[str], states: dict[str, tuple[str, int]], done: list[str], waiting: list[str], at: str) -> DataFrame:
    """For each connector its files in seven buckets, those not yet processed, first and last time, and one state.

    ``states`` maps a stage to its state and rank. The state is that of the highest rank, but ``uploaded`` (rank 1) while some
    file waits.
    """
    bucket = F.when(F.col("status").isin("failed", "skipped"), F.col("status")).when(F.col("stage") == "superseded", "superseded").when(F.col("stage") == "processing", "processing").when(F.col("stage").isin(*done), "processed").otherwise("pending")
    rank = F.coalesce(*[F.when(F.col("stage") == k, r) for k, (_, r) in states.items()], F.lit(0))
    counts = [F.count_if(bucket == b).alias(b) for b in ("pending", "processing", "processed", "failed", "skipped", "superseded")]
    g = files.groupBy(*keys).agg(F.count("*").alias("files_total"), *counts, F.count_if(F.col("stage").isin(*waiting)).alias("unprocessed"), F.min(at).alias("earliest"), F.max(at).alias("latest"), F.max(rank).alias("_rank"))
    named = F.coalesce(*[F.when(F.col("_rank") == r, s) for s, r in states.values()], F.lit("not_configured"))
    return g.withColumn("status", F.when((F.col("unprocessed") > 0) & (F.col("_rank") > 1), "uploaded").otherwise(named)).drop("_rank")


def header_tables(present: DataFrame, declared: DataFrame) -> DataFrame:
    """Each declared dataset's headers: declared, present, coverage_pct, missing, extra, status (BLOCK if a required column is missing, WARN if another).

    ``present`` (dataset, column) are the columns that datasets have, ``declared`` (dataset, column, required) those they should have. A
    dataset without a column is missing them all; datasets that nobody declares are left out. Columns are told in order.
    """
    have = present.select("dataset", "column").distinct().withColumn("_here", F.lit(True))
    want = declared.groupBy("dataset", "column").agg(F.max("required").alias("required"))
    both = have.join(want, ["dataset", "column"], "full")
    named = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("column")))), ",")
    told, here = F.col("required").isNotNull(), F.coalesce("_here", F.lit(False))
    g = both.groupBy("dataset").agg(F.count_if(told).alias("declared"), F.count_if(told & here).alias("present"), named(told & ~here).alias("missing"), named(~told & here).alias("extra"), F.count_if(told & ~here & F.col("required")).alias("_blocks"))
    status = F.when(F.col("_blocks") > 0, "BLOCK").when(F.col("missing") != "", "WARN").otherwise("PASS")
    return g.where("declared > 0").select("dataset", "declared", "present", F.round(F.col("present") / F.col("declared") * 100, 2).alias("coverage_pct"), "missing", "extra", status.alias("status"))
