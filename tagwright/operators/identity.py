"""Which asset a row is about: ladders from sure to less sure, each with its method and confidence. Nothing is guessed: a row
without a match says so. References are joined by equality on derived keys; no side is compared pair by pair."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tagwright.functions import tags
from tagwright.functions.text import match_key, non_blank, normalize_tag, text

# Confidence by method.
FINDINGS = {"sap_equipment": 1.0, "equipment_tag": 0.95, "floc_tail": 0.85, "floc_segment": 0.80, "text_extract": 0.60, "unmatched": 0.0}
DOCUMENTS = {"inline_tag": 0.95, "name_map": 0.85, "name_fallback": 0.50, "none": 0.0}
NAMES = {
    "crusher": "CP-CR-0001",
    "raw mill": "CP-RM-0001",
    "vrm": "CP-RM-0001",
    "vertical roller mill": "CP-RM-0001",
    "preheater": "CP-PH-0001",
    "pre-heater": "CP-PH-0001",
    "kiln": "CP-KN-0001",
    "rotary kiln": "CP-KN-0001",
    "coal mill": "CP-CO-0001",
    "cooler": "CP-CC-0001",
    "clinker cooler": "CP-CC-0001",
    "cement mill": "CP-CM-0001",
    "ball mill": "CP-CM-0001",
    "packer": "CP-PP-0001",
}
INLINE = r"^[0-9]{3}[A-Z]|^CP-[A-Z]{2}-[0-9]{4}|^B[0-9]{2}-[A-Z]"
FUZZY = 0.84
GRAM = 3


def findings(df: DataFrame, sap: tuple[str, ...] = (), equipment: tuple[str, ...] = (), flocs: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with normalized_asset, asset_match_method and asset_match_confidence: the first of the columns of each kind that
    names an asset, kind by kind."""
    of = lambda asset, how: F.when(asset != "", F.struct(asset.alias("asset"), F.lit(how).alias("method")))
    rungs = [of(tags.cleaned(c), "sap_equipment") for c in sap] + [of(tags.cleaned(c), "equipment_tag") for c in equipment]
    rungs += [tags.from_floc(c) for c in flocs] + [of(tags.from_text(c), "text_extract") for c in texts]
    best = F.coalesce(*rungs, F.struct(F.lit("").alias("asset"), F.lit("unmatched").alias("method")))
    out = df.withColumn("_best", best)
    return out.withColumns({"normalized_asset": F.col("_best.asset"), "asset_match_method": F.col("_best.method"), "asset_match_confidence": tags.mapped(F.col("_best.method"), FINDINGS)}).drop("_best")


def first_by_key(reference: DataFrame, value: str, key: Column, order: str) -> DataFrame:
    """key, value: of the reference's values with one key the first by ``order``; blank keys go."""
    rows = reference.select(key.alias("key"), text(value).alias("value"), F.col(order).alias("_order")).where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("value", F.struct("_order", "value")).alias("value"))


def alerts(df: DataFrame, key: str, tag: str, description: str, equipment: DataFrame, equipment_id: str) -> DataFrame:
    """key, equipment_id, normalized_asset, method, confidence: by the tag, or where that is blank by the first word of the
    description that is an equipment's. A tag that is none stays as normalized_asset; no candidate has no confidence."""
    known = first_by_key(equipment, equipment_id, match_key(equipment_id), equipment_id)
    rows = df.select(key, non_blank(tag).alias("_tag"), F.when(F.length(text(tag)) > 0, F.array(match_key(tag))).otherwise(F.transform(tags.description_candidates(description), match_key)).alias("_keys"))
    tried = rows.select(key, F.posexplode("_keys").alias("_place", "key")).join(known, "key")
    hit = tried.groupBy(key).agg(F.min_by("value", "_place").alias("equipment_id"))
    out = rows.join(hit, key, "left")
    found, by_tag = F.col("equipment_id").isNotNull(), F.col("_tag").isNotNull()
    method = F.when(by_tag & found, "tag_number").when(by_tag, "tag_number_unmatched").when(found, "description").when(F.size("_keys") == 0, "description_no_candidate").otherwise("description_unmatched")
    confidence = F.when(by_tag & found, 1.0).when(found, 0.8).when(~by_tag & (F.size("_keys") == 0), None).otherwise(0.0)
    asset = F.coalesce("equipment_id", F.when(by_tag, F.nullif(match_key("_tag"), F.lit(""))))
    return out.select(key, "equipment_id", asset.alias("normalized_asset"), method.alias("asset_match_method"), confidence.alias("asset_match_confidence"))


def sap_to_pid(df: DataFrame, key: str, sap_id: str, floc: str, reference: DataFrame, asset_columns: list[str], tag: str, order: str) -> DataFrame:
    """key, pid_asset_tag, asset_match_method, asset_match_confidence: a reference asset equal to the id 1.0, else a tag in the location 0.85."""
    rows = reference.select(text(tag).alias("tag"), F.col(order).alias("_order"), F.posexplode(F.array(*map(text, asset_columns))).alias("_column", "asset"))
    first = F.struct("_order", "_column", "tag")
    exact = rows.select(match_key("asset").alias("key"), "tag", first.alias("_first")).where("key <> ''").groupBy("key").agg(F.min_by("tag", "_first").alias("exact"))
    bare = lambda c: F.replace(F.upper(c), F.lit("-"), F.lit(""))
    by_tag = rows.select(bare(F.col("tag")).alias("key"), "tag", first.alias("_first")).groupBy("key").agg(F.min_by("tag", "_first").alias("by_floc"))
    asked = df.select(key, match_key(sap_id).alias("_key"), tags.floc_candidates(floc).alias("_tags"))
    places = asked.where("_key <> ''").select(key, F.posexplode(F.transform("_tags", bare)).alias("_place", "key")).join(by_tag, "key")
    places = places.groupBy(key).agg(F.min_by("by_floc", "_place").alias("by_floc"))
    places = places.withColumnRenamed(key, "_row")
    out = asked.join(exact, F.col("_key") == F.col("key"), "left").join(places, F.col(key) == F.col("_row"), "left")
    sure, likely = F.col("exact").isNotNull(), F.col("by_floc").isNotNull()
    return out.select(
        key,
        F.coalesce("exact", "by_floc", F.lit("")).alias("pid_asset_tag"),
        F.when(sure, "exact").when(likely, "floc").otherwise("none").alias("asset_match_method"),
        F.when(sure, 1.0).when(likely, 0.85).otherwise(0.0).alias("asset_match_confidence"),
    )


def on_diagram(df: DataFrame, equipment_id: str, reference: DataFrame, asset: str, order: str) -> DataFrame:
    """``df`` with whether the diagrams know its equipment, under which name, and how surely (1.0 or null)."""
    known = first_by_key(reference, asset, normalize_tag(asset), order).withColumnsRenamed({"key": "_key", "value": "_value"})
    out = df.join(known, normalize_tag(equipment_id) == F.col("_key"), "left")
    return out.withColumns({"pid_matched": F.col("_key").isNotNull(), "pid_asset": F.coalesce("_value", F.lit("")), "pid_confidence": F.when(F.col("_key").isNotNull(), 1.0)}).drop("_key", "_value")


def grams(c: Column, sizes: range) -> Column:
    """The distinct runs of so many characters."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda start: F.substring(c, start, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*[F.when(F.length(c) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in sizes])))


def contained(long: DataFrame, short: DataFrame) -> DataFrame:
    """id, key: pairs of ``long`` (id, text) and ``short`` (key) whose key is part of the text.

    A key is posted once, under its rarest run of GRAM characters (whole, if shorter), and the texts' runs are joined with
    these by equality, so that only texts that share a key's rarest run are compared with it.
    """
    keys = short.where("key <> ''").distinct()
    posts = keys.select("key", F.explode(F.when(F.length("key") < GRAM, F.array("key")).otherwise(grams(F.col("key"), range(GRAM, GRAM + 1)))).alias("gram"))
    rare = posts.join(posts.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("key").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    runs = long.select("id", "text", F.explode(grams(F.col("text"), range(1, GRAM + 1))).alias("gram"))
    return runs.join(rare, "gram").where(F.contains("text", "key")).select("id", "key")


def crosswalk(sap: DataFrame, pid: DataFrame, plant: str) -> DataFrame:
    """Equipment (sap_id, normalized_asset) to diagram tags (tag, normalized_asset, seq): an equal asset, an equal tag, or the
    first asset (by seq) that is part of the equipment's. One row for each tag and equipment, without blank ids."""
    side = pid.select(text("tag").alias("tag"), F.upper(text("normalized_asset")).alias("norm"), "seq").withColumn("name", F.coalesce(non_blank("tag"), non_blank("norm"))).where("name is not null")
    by_norm = side.where("norm <> ''").groupBy("norm").agg(F.max_by("name", "seq").alias("by_norm"), F.min("seq").alias("first"))
    by_tag = side.where("tag <> ''").groupBy(F.upper("tag").alias("tag_key")).agg(F.max_by("name", "seq").alias("by_tag"))
    rows = sap.select(text("sap_id").alias("sap_id"), F.upper(text("normalized_asset")).alias("asset")).where("sap_id <> ''").distinct()
    pairs = contained(rows.select(F.col("asset").alias("id"), F.col("asset").alias("text")).distinct(), by_norm.select(F.col("norm").alias("key")))
    inside = pairs.join(by_norm, F.col("key") == F.col("norm")).groupBy("id").agg(F.min_by("by_norm", "first").alias("inside"))
    out = rows.join(by_norm, rows.asset == by_norm.norm, "left").join(by_tag, rows.asset == by_tag.tag_key, "left").join(inside, rows.asset == inside.id, "left")
    method = F.when(F.col("by_norm").isNotNull(), "exact_normalized_asset").when(F.col("by_tag").isNotNull(), "exact_pid_tag").otherwise("contains_pid_tag")
    out = out.select(F.coalesce("by_norm", "by_tag", "inside").alias("pid_tag"), "sap_id", "asset", method.alias("match_method")).where("pid_tag is not null")
    one = out.groupBy(F.upper("pid_tag").alias("_tag"), F.upper("sap_id").alias("_id")).agg(F.min(F.struct("pid_tag", "sap_id", "asset", "match_method")).alias("r"))
    confidence = F.when(F.col("r.match_method") == "contains_pid_tag", 0.8).otherwise(1.0)
    return one.select(F.lit(plant).alias("plant_code_id"), "r.pid_tag", F.col("r.sap_id").alias("sap_equipment_id"), F.col("r.asset").alias("normalized_asset"), "r.match_method", confidence.alias("confidence"))


def asset_link(df: DataFrame, tag: str, components: DataFrame) -> DataFrame:
    """tag, asset, method, confidence by ``components`` (tag, type, description, seq): the tag itself, its part before an
    underscore, a tag that one of both begins with, one of its family of three digits, else that part alone. Of several an
    ``Equipment``, then the shortest, then the first."""
    comp = components.select(F.upper(text("tag")).alias("ct"), F.coalesce(non_blank("description"), F.upper(text("tag"))).alias("name"), F.struct((F.lower(text("type")) != "equipment").alias("other"), F.length(F.upper(text("tag"))).alias("size"), F.col("seq")).alias("rank")).where("ct <> ''")
    rows = df.select(F.upper(text(tag)).alias("tag")).distinct().withColumn("base", F.substring_index("tag", "_", 1))
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    pick = lambda how, rank: F.struct(F.lit(rank).alias("tier"), F.col("rank"), F.col("name").alias("asset"), F.lit(how).alias("method"))
    first = comp.groupBy("ct").agg(F.min_by("name", "rank.seq").alias("name"), F.min(F.struct(F.lit(False).alias("other"), F.lit(0).alias("size"), F.col("rank.seq"))).alias("rank"))
    exact = rows.join(first, rows.tag == first.ct).select("tag", pick("exact_tag", 1).alias("hit"))
    base = rows.join(first, rows.base == first.ct).select("tag", pick("exact_base", 2).alias("hit"))
    # one component of each prefix and family is enough, the best
    by_prefix = comp.select(F.explode(prefixes(F.col("ct"))).alias("prefix"), F.struct("rank", "name").alias("c")).groupBy("prefix").agg(F.min("c").alias("c")).select("prefix", "c.*")
    by_family = comp.select(F.substring("ct", 1, 3).alias("family"), F.struct("rank", "name").alias("c")).groupBy("family").agg(F.min("c").alias("c")).select("family", "c.*")
    by_tag = comp.select("ct", F.struct("rank", "name").alias("c")).groupBy("ct").agg(F.min("c").alias("c")).select("ct", "c.*")
    below = rows.where("base <> ''").join(by_prefix, F.col("base") == F.col("prefix")).select("tag", pick("prefix_contains", 3).alias("hit"))
    above = rows.where("base <> ''").select("tag", F.explode(prefixes(F.col("base"))).alias("prefix")).join(by_tag, F.col("prefix") == F.col("ct")).select("tag", pick("prefix_contains", 3).alias("hit"))
    family = rows.where(F.col("base").rlike("^[0-9]{3}")).join(by_family, F.substring("base", 1, 3) == F.col("family")).select("tag", pick("family_3digit", 4).alias("hit"))
    best = exact.union(base).union(below).union(above).union(family).groupBy("tag").agg(F.min("hit").alias("hit"))
    confidence = tags.mapped(F.col("method"), {"exact_tag": 1.0, "exact_base": 0.95, "prefix_contains": 0.8, "family_3digit": 0.6, "fallback_base_tag": 0.4})
    out = rows.join(best, "tag", "left").select("tag", F.coalesce("hit.asset", "base").alias("asset"), F.coalesce("hit.method", F.lit("fallback_base_tag")).alias("method"))
    return out.withColumn("confidence", confidence)


def documents(df: DataFrame, tag: str, name: str, names: dict[str, str] = NAMES) -> DataFrame:
    """``df`` with normalized_asset, method and confidence: a tag as plants write them, else the longest known name in the
    name (or in the tag, where there is no name), else the tag or name as it is."""
    t, n = text(tag), text(name)
    low = F.lower(F.coalesce(F.nullif(n, F.lit("")), t))
    known = F.coalesce(*[F.when(F.contains(low, F.lit(k)), names[k]) for k in sorted(names, key=lambda k: (-len(k), k))])
    of = lambda asset, how: F.struct(asset.alias("asset"), F.lit(how).alias("method"))
    either = F.coalesce(F.nullif(t, F.lit("")), n)
    best = F.when(t.rlike(INLINE), of(t, "inline_tag")).when(known.isNotNull(), of(known, "name_map")).when(either != "", of(either, "name_fallback")).otherwise(of(F.lit(""), "none"))
    out = df.withColumn("_best", best)
    return out.withColumns({"normalized_asset": F.col("_best.asset"), "asset_match_method": F.col("_best.method"), "asset_match_confidence": tags.mapped(F.col("_best.method"), DOCUMENTS)}).drop("_best")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two texts that matching blocks have; a column at a time."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def series(df: DataFrame, row: str, key: str, reference: DataFrame, least: int = 3) -> DataFrame:
    """row, asset, method, confidence of historian tags by ``reference`` (key, asset, seq): an equal key, one that is part of the
    other (the nearest in length), or one that reads alike by FUZZY and more.

    Two keys name one asset only if all their numbers and the letters behind the last one agree: that is what they are joined
    by, so that no key is compared with those of other assets. Of keys that read alike those with the same first three letters
    count, if any reference has these; ties go to the first by ``seq``.
    """
    same = lambda c: F.concat_ws("|", F.array_join(tags.numeric_parts(c), ","), tags.sibling_suffix(c))
    ref = reference.select(F.col("key").alias("_rk"), F.col("asset").alias("_asset"), "seq").where("_rk <> ''").withColumn("_same", same("_rk"))
    rows = df.select(row, text(key).alias("_k")).withColumn("_same", same("_k"))
    exact = ref.groupBy("_rk").agg(F.min_by("_asset", "seq").alias("_exact"))
    out = rows.join(exact, rows._k == exact._rk, "left").drop("_rk")
    open_ = out.where(F.col("_exact").isNull() & (F.length("_k") >= least)).select(row, "_k", "_same")
    met = open_.join(ref, "_same").where(F.length("_rk") >= least)
    inside = met.where(F.contains("_rk", "_k") | F.contains("_k", "_rk"))
    inside = inside.groupBy(row).agg(F.min_by("_asset", F.struct(F.abs(F.length("_rk") - F.length("_k")), "_rk", "seq")).alias("_inside"))
    begins = ref.select(F.substring("_rk", 1, 3).alias("_begin")).distinct()
    near = open_.join(inside.select(row), row, "left_anti").join(begins, F.substring("_k", 1, 3) == F.col("_begin"), "left")
    near = near.join(ref, "_same").where(F.col("_begin").isNull() | F.startswith("_rk", F.col("_begin"))).withColumn("_score", similarity("_k", "_rk")).where(F.col("_score") >= FUZZY)
    alike = near.groupBy(row).agg(F.min_by("_asset", F.struct(-F.col("_score"), "seq")).alias("_alike"), F.max("_score").alias("_score"))
    out = out.join(inside, row, "left").join(alike, row, "left")
    method = F.when(F.col("_exact").isNotNull(), "exact").when((F.length("_k") < least) & (F.col("_k") != ""), "key_too_short").when(F.col("_inside").isNotNull(), "contains").when(F.col("_alike").isNotNull(), "fuzzy").otherwise("none")
    confidence = F.when(method == "exact", 1.0).when(method == "contains", 0.92).when(method == "fuzzy", F.col("_score")).otherwise(0.0)
    return out.select(row, F.coalesce("_exact", "_inside", "_alike", F.lit("")).alias("asset"), method.alias("method"), confidence.alias("confidence"))
