"""What a run leaves: failure modes, review lists, progress, causes, ledgers, states, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.text import composite_key, is_blank, non_blank, text
from tagwright.operators.tables import keep_first

# Signs of a cause in a run's output, most telling first.
CAUSES = [
    ("All API keys exhausted", "gemini_quota_exhausted"),
    ("credits depleted", "gemini_quota_exhausted"),
    ("TooManyRequests", "gemini_rate_limited"),
    ("API_KEY_INVALID", "gemini_bad_key"),
    ("No equipment or connectivity data found", "no_content_extracted"),
    ("No source data found", "no_source_data"),
]


def failure_table(rows: DataFrame, plant: str, kind: str, what: str, equipment: str, place: str, keep: list[str] = ()) -> DataFrame:
    """One of the tables (``FM``, ``FC``, ``FE``) of a failure analysis: a code from the equipment and the row's place (from 0), one row a code."""
    number = F.lpad((F.col(place) + 1).cast("string"), 3, "0")
    padded = F.when(F.col(place) + 1 > 999, (F.col(place) + 1).cast("string")).otherwise(number)
    code = F.substring(F.concat_ws("_", F.lit(kind), non_blank(equipment), padded), 1, 60)
    named = rows.where(~is_blank(what)).select(F.lit(plant).alias("plant_code_id"), code.alias("code"), text(what).alias("text"), text(equipment).alias("equipment_id"), place, *keep)
    return keep_first(named, ["plant_code_id", "code"], [place]).drop(place)


def review_list(rows: DataFrame, record: str, others: list[str], order: str) -> DataFrame:
    """Rows to be reviewed, the first of each record; rows without an id are told apart by ``others``."""
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("r"), non_blank(record)), F.concat(F.lit("o"), composite_key(*others))))
    return keep_first(keyed, ["_key"], [order]).drop("_key")


def progress(markers: DataFrame, job: str, order: str, phase: str, done: str, total: str, weights: dict[str, float]) -> DataFrame:
    """markers with ``percent``: the weight of the phases before and the share of the present one, never less than before."""
    before, at = {}, 0.0
    for name, w in weights.items():
        before[name], at = at, at + w
    pick = lambda m: F.coalesce(*[F.when(F.col(phase) == k, F.lit(float(v))) for k, v in m.items()], F.lit(0.0))
    share = F.when(F.col(total) > 0, F.least(F.lit(1.0), F.col(done) / F.col(total))).otherwise(0.0)
    raw = pick(before) + pick(weights) * share
    return markers.withColumn("percent", F.round(F.max(raw).over(Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) / at * 100, 6))


def cause(output: Column | str) -> Column:
    """struct(category, evidence) of a run that gave no rows: the first sign that its output has, and the line that has it."""
    t = F.coalesce(F.col(output) if isinstance(output, str) else output, F.lit(""))
    lines = F.split(t, "\n")
    line = lambda sign: F.substring(F.trim(F.get(F.filter(lines, lambda x: F.contains(F.lower(x), F.lit(sign.lower()))), F.lit(0))), 1, 240)
    of = lambda category, evidence: F.struct(F.lit(category).alias("category"), evidence.alias("evidence"))
    filled = F.filter(lines, lambda x: F.trim(x) != "")
    found = [F.when(F.contains(F.lower(t), F.lit(sign.lower())), of(category, line(sign))) for sign, category in CAUSES]
    last = F.element_at(filled, -1)
    tail = F.when(F.length(last) > 240, F.substring(last, -240, 240)).otherwise(last)
    return F.when(F.trim(t) == "", of("empty_output", F.lit(""))).otherwise(F.coalesce(*found, of("zero_rows_unknown_cause", tail)))


def flow_now(events: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The state of each file after all its events: each column's last value that is not null, and the number of events."""
    return events.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns], F.count("*").alias("n_events"))


def interrupted(jobs: DataFrame, live: DataFrame, job: str, status: str = "status") -> DataFrame:
    """Jobs, those that run with no live process marked as interrupted."""
    alive = live.select(F.col(job).alias("_live")).distinct()
    out = jobs.join(alive, F.col(job) == F.col("_live"), "left")
    return out.withColumn(status, F.when((F.col(status) == "running") & F.col("_live").isNull(), "interrupted").otherwise(F.col(status))).drop("_live")


def breadcrumbs(events: DataFrame, session: str, order: str, most: int) -> DataFrame:
    """The last events of each session with their true place in it. No more than ``most`` of a session's rows are gathered; its length is a count."""
    n = events.groupBy(session).agg(F.count("*").alias("_n"))
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    last = events.withColumn("_back", back).where(F.col("_back") <= most)
    return last.join(n, session).withColumn("place", F.col("_n") - F.col("_back") + 1).drop("_back", "_n")


def permissions(grants: DataFrame, user: str, plant: str, feature: str, letter: str) -> DataFrame:
    """Each user's plants and features with the letters granted, as a map of maps. A user has as many as there are features."""
    letters = grants.groupBy(user, plant, feature).agg(F.array_join(F.array_sort(F.collect_set(letter)), "").alias("_l"))
    plants = letters.groupBy(user, plant).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(feature, "_l")))).alias("_f"))
    return plants.groupBy(user).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(plant).alias("key"), F.to_json("_f").alias("value"))))).alias("granted"))


def label_errors(files: DataFrame, name: str, labels: str, known: list[str]) -> DataFrame:
    """name, labels in the known order, unknown ones, and whether none is left."""
    order = F.array(*map(F.lit, known))
    good = F.array_intersect(order, F.col(labels))
    return files.select(name, good.alias("labels"), F.array_sort(F.array_except(F.col(labels), order)).alias("unknown"), (F.size(good) == 0).alias("missing"))


def manifest(uploaded: DataFrame, described: DataFrame, name: str) -> DataFrame:
    """name, state of files that nobody described and of descriptions without a file."""
    a, b = uploaded.select(name).distinct(), described.select(name).distinct()
    return a.join(b, name, "left_anti").withColumn("state", F.lit("undescribed")).union(b.join(a, name, "left_anti").withColumn("state", F.lit("stray")))


def joined(tables: dict[str, DataFrame], base: str, steps: list[tuple[str, list[tuple[str, str]], str]]) -> DataFrame:
    """``base`` joined in turn with (table, [(left column, right column)], how); columns that both have keep the left's."""
    out = tables[base]
    for name, on, how in steps:
        right = tables[name]
        keys = [F.col(b).alias(f"_{i}") for i, (_, b) in enumerate(on)]
        side = right.select(*keys, *[c for c in right.columns if c not in out.columns])
        hit = F.lit(True)
        for i, (a, _) in enumerate(on):
            hit = hit & (out[a] == F.col(f"_{i}"))
        out = out.join(side, hit, how).drop(*[f"_{i}" for i in range(len(on))])
    return out
