"""URL filters: host and path rules first, then rules that FP-growth mines from the URLs that those decide.

Everything is DataFrame functions and Spark's own FP-growth.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.shared import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "verdict:block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where ``://`` is missing."""
    text, shape = F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, shape, 1), UPPER, LOWER), F.regexp_extract(text, shape, 2)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all hosts below it.

    The list is part of the plan: some hundreds of rules at most. Of rules of one length the longer host wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.host, r.verdict))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def items(url: Column, host: Column, path: Column) -> Column:
    """What a URL is made of: its host's labels but for the most general, its path's words, its query's names. Numbers are one word."""
    number = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    words = lambda x, sep: F.filter(F.split(F.lower(x), sep), lambda w: w != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    labels = F.transform(words(host, r"\."), lambda w: F.concat(F.lit("host:"), number(w)))
    parts = F.transform(words(path, "[/.]"), lambda w: F.concat(F.lit("path:"), number(w)))
    names = F.transform(words(query, "&"), lambda w: F.concat(F.lit("query:"), number(F.regexp_extract(w, "^[^=]*", 0))))
    return F.array_sort(F.array_distinct(F.concat(labels, parts, names)))


def mine(labelled: DataFrame, support: float, confidence: float) -> tuple[DataFrame, dict[str, str]]:
    """Rules ``antecedent`` (array<string>) -> block, with confidence and support, from ``labelled`` (items, verdict), and stand-ins.

    Only the most general rules stay: one that has another's items and more says nothing new. So FP-growth, whose frequent
    sets are exponential in the items of a URL, is spared what cannot be in such a rule with others: items that are too
    rare among the blocked URLs, items that are a rule by themselves, and of items that stand in exactly the same URLs all
    but the first. The stand-ins map each of the others to the first: a rule with the one holds for URLs with the other.
    """
    baskets = staged(labelled.select("items", (F.col("verdict") == "block").alias("block")).where("size(items) > 0 or block"), "baskets")
    n = baskets.count()
    least = max(1, math.ceil(support * n))
    place = F.xxhash64("items").cast("decimal(38,0)")
    each = baskets.select(F.explode("items").alias("item"), place.alias("place"), "block").groupBy("item").agg(F.count("*").alias("n"), F.count_if("block").alias("blocked"), F.sum("place").alias("places"))
    # some of a URL's items are this frequent, so at most (items a URL) / support rows
    frequent = each.where(F.col("blocked") >= least).orderBy("item").collect()
    single = [r for r in frequent if r.blocked / r.n >= confidence]
    first: dict[tuple, str] = {}
    stand_in = {r.item: first.setdefault((r.n, r.blocked, r.places), r.item) for r in frequent if r.blocked / r.n < confidence}
    kept = F.array_intersect("items", F.array(*map(F.lit, first.values())).cast("array<string>"))
    marked = baskets.select(F.when(F.col("block"), F.array_append(kept, F.lit(BLOCK))).otherwise(kept).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(marked).associationRules
    several = found.where(F.array_contains("consequent", BLOCK)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    alone = labelled.sparkSession.createDataFrame([([r.item], r.blocked / r.n, r.blocked / n) for r in single], several.schema)
    rules = staged(several.union(alone), "rules")
    a, b = rules.alias("a"), rules.select("antecedent", F.explode("antecedent").alias("item")).alias("b")
    narrow = (
        rules.select(F.col("antecedent").alias("wide"), F.explode("antecedent").alias("item"))
        .alias("w")
        .join(b, "item")
        .where(F.col("wide") != F.col("antecedent"))
        .groupBy("wide", "antecedent")
        .agg(F.count("*").alias("shared"))
        .where(F.col("shared") == F.size("antecedent"))
        .select("wide")
        .distinct()
    )
    return a.join(narrow, F.col("a.antecedent") == F.col("wide"), "left_anti").select("antecedent", "confidence", "support"), {a: b for a, b in stand_in.items() if a != b}


def stood_for(items: Column, stand_in: dict[str, str]) -> Column:
    """``items`` with the stand-ins of those that have one in place of them."""
    if not stand_in:
        return items
    named = F.create_map(*[F.lit(x) for pair in stand_in.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: F.coalesce(F.try_element_at(named, x), x))))


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``items`` of ``sets`` that have all items of some rule.

    The index holds each rule once, under its item that the fewest rules have (ties by name), so that common items pull in
    few rules; a rule found there counts if the set holds the rest.
    """
    spread = rules.select("antecedent", F.explode("antecedent").alias("item"))
    often = spread.groupBy("item").agg(F.count("*").alias("n"))
    index = spread.join(often, "item").groupBy("antecedent").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    posts = sets.select("items", F.explode("items").alias("item"))
    return posts.join(index, "item").where(F.size(F.array_except("antecedent", "items")) == 0).select("items").distinct()


def judge(pages: DataFrame, rules: list[Rule], support: float = 0.005, confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    A rule's verdict stands; other URLs are blocked if a mined rule matches them, else allowed. ``support`` is a share of
    the URLs that the rules decide. No such URL, or an empty table, mines no rule. A null URL has neither host nor path and
    is allowed; rows repeat as they are.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rows = rows.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("items", items(F.col("url"), F.col("host"), F.col("path")))
    rows = staged(rows.select("page_id", "host", "path", "hit", "items"), "urls")
    known = rows.where("hit is not null").select("items", F.col("hit.verdict").alias("verdict"))
    open_ = rows.where("hit is null")
    if known.isEmpty():
        return rows.select("page_id", "host", "path", "hit.rule", F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))
    mined, stand_in = mine(known, support, confidence)
    # URLs are joined under a number of their items; all rows that a rule decides stay out of the join
    stood = open_.withColumn("items", stood_for(F.col("items"), stand_in)).withColumn("_set", F.xxhash64("items"))
    sets = stood.groupBy("_set", "items").agg(F.count("*").alias("n"))
    blocked = matched(sets.select("items"), mined).select(F.xxhash64("items").alias("_blocked"), F.col("items").alias("_items"))
    judged = stood.join(blocked, (F.col("_set") == F.col("_blocked")) & (F.col("items") == F.col("_items")), "left")
    by_rule = rows.where("hit is not null").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))
    return by_rule.union(judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("_blocked").isNotNull(), "block").otherwise("allow").alias("verdict")))
