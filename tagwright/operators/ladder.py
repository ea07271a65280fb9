"""The whole ladder that gives historian tags their assets and equipment, by a policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.functions import tags
from tagwright.functions.text import match_key, text
from tagwright.operators import identity


@dataclass(frozen=True)
class Policy:
    """Fixed values are the defaults: how tags are cut, which columns of the reference name assets and equipment, from which score on keys read alike."""

    separator_insensitive: bool = True
    candidate_columns: tuple[str, ...] = ("normalized_asset", "equipment_tag", "equipment_id", "functional_location", "floc", "canonical_code")
    equipment_id_columns: tuple[str, ...] = ("equipment_id", "equipment_tag", "normalized_asset", "sap_equipment_id")
    identity_column: str = "normalized_asset"
    fuzzy_threshold: float = 0.85
    least_key: int = 3
    attribute_separators: tuple[str, ...] = (".", ":")
    path_separators: tuple[str, ...] = ("!", "\\", "/")
    duplicate_suffix: str = "#"
    aggregate_suffixes: tuple[str, ...] = ("ENERGY", "COUNT", "COUNTER", "TOTAL", "TOT")
    instrument_suffixes: tuple[str, ...] = ("IZ", "SZ", "FZ", "LZ", "TZ", "VZ", "ZZ", "PZ")


def spaced(c):
    """Upper case words of letters and digits."""
    return F.trim(F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]+", " "))


def reference_assets(reference: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """match_key, asset, identity, equipment_id, source, seq: each name that a row of ``reference`` (with ``seq``) has for its asset.

    The equipment is the first of the policy's columns that has one, the identity the policy's identity column, else the name itself. Names
    without a letter or digit are none.
    """
    names = [c for c in policy.candidate_columns if c in reference.columns]
    ids = [text(c) for c in policy.equipment_id_columns if c in reference.columns]
    equipment = F.coalesce(*[F.nullif(c, F.lit("")) for c in ids], F.lit(""))
    identity_ = text(policy.identity_column) if policy.identity_column in reference.columns else F.lit("")
    each = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(c).alias("source"), text(c).alias("asset")) for k, c in enumerate(names)]) if names else F.array().cast("array<struct<rank:int,source:string,asset:string>>")
    rows = reference.select(equipment.alias("equipment_id"), identity_.alias("_identity"), "seq", F.explode(each).alias("x")).where("x.asset <> ''")
    key = match_key("x.asset") if policy.separator_insensitive else spaced(F.col("x.asset"))
    rows = rows.select(key.alias("match_key"), F.col("x.asset").alias("asset"), F.coalesce(F.nullif("_identity", F.lit("")), "x.asset").alias("identity"), "equipment_id", "x.source", F.struct("seq", "x.rank").alias("seq"))
    return rows.where(spaced("asset") != "")


def resolved(df: DataFrame, row: str, reference: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``df`` (``row``, tag_name, and perhaps normalized_asset and equipment_id) with normalized_asset, equipment_id, asset_match_method, asset_match_confidence, asset_match_key.

    A row's asset is its own, else the key in its tag, else the tag. With a reference: a row that has an equipment keeps it as it is (``source_only_no_pid_match``)
    or takes the reference's spelling of it (``source_verified_against_pid``, ``source_relinked_to_pid``); a row without looks its key up
    (``pid_match_key``), then the nearest key (``pid_contains``, ``pid_fuzzy``, ``pid_exact``) from the policy's threshold on. Names of the identity column go
    before others, then the first. Without one, rows keep what they say. ``row`` is unique; other columns stay.
    """
    own = lambda c: text(c) if c in df.columns else F.lit("")
    parts = {"duplicate": policy.duplicate_suffix, "paths": policy.path_separators, "attributes": policy.attribute_separators}
    key = tags.asset_key("tag_name", aggregates=policy.aggregate_suffixes, instruments=policy.instrument_suffixes, least=policy.least_key, **parts)
    rows = df.select(row, own("tag_name").alias("_tag"), key.alias("_key"), own("normalized_asset").alias("_asset"), own("equipment_id").alias("_eq"))
    base = F.when(F.col("_asset") != "", "source_asset").when(F.col("_key") != "", "tag_pattern").otherwise("tag_name_fallback")
    rows = rows.withColumns({"_base": base, "_own": F.coalesce(*[F.nullif(c, F.lit("")) for c in ("_asset", "_key")], F.col("_tag")), "_search": F.coalesce(F.nullif("_key", F.lit("")), F.col("_tag"))})
    others = [c for c in df.columns if c not in ("normalized_asset", "equipment_id", "asset_match_method", "asset_match_confidence", "asset_match_key")]
    told = lambda out: df.select(*others).join(out, row)
    ref = reference_assets(reference, policy)
    if ref.isEmpty():
        plain = F.when(F.col("_base") == "tag_name_fallback", 0.5).otherwise(0.9)
        return told(rows.select(row, F.col("_own").alias("normalized_asset"), F.col("_eq").alias("equipment_id"), F.col("_base").alias("asset_match_method"), plain.alias("asset_match_confidence"), F.col("_key").alias("asset_match_key")))
    first = F.struct((F.col("source") != policy.identity_column).alias("other"), "seq")
    by_key = ref.where("match_key <> ''").groupBy("match_key").agg(F.min_by(F.struct("identity", "equipment_id"), first).alias("_hit"))
    asked = F.when(F.col("_eq") != "", F.col("_eq")).otherwise(F.col("_search"))
    rows = rows.withColumn("_ask", match_key(asked) if policy.separator_insensitive else spaced(asked)).join(by_key, F.col("_ask") == F.col("match_key"), "left").drop("match_key")
    hit = F.coalesce(F.col("_hit.equipment_id") != "", F.lit(False))
    open_ = rows.where((F.col("_eq") == "") & ~hit).select(row, spaced("_search").alias("_k"))
    near = identity.series(open_, row, "_k", ref.select(F.col("match_key").alias("key"), F.col("equipment_id").alias("asset"), "seq"), policy.least_key)
    near = near.where((F.col("asset") != "") & (F.col("confidence") >= policy.fuzzy_threshold)).select(row, F.col("asset").alias("_near"), F.col("method").alias("_how"), F.col("confidence").alias("_score"))
    out = rows.join(near, row, "left")
    verified = F.when(F.col("_hit.equipment_id") == F.col("_eq"), "source_verified_against_pid").otherwise("source_relinked_to_pid")
    method = F.when(F.col("_eq") != "", F.when(hit, verified).otherwise("source_only_no_pid_match")).when(hit, "pid_match_key").when(F.col("_near").isNotNull(), F.concat(F.lit("pid_"), "_how")).otherwise(F.concat("_base", F.lit("_no_pid_match")))
    confidence = F.when(hit, 1.0).when(F.col("_near").isNotNull(), F.col("_score")).otherwise(0.4)
    return told(out.select(row, F.when(hit, F.coalesce(F.nullif("_hit.identity", F.lit("")), "_own")).otherwise(F.col("_own")).alias("normalized_asset"), F.when(hit, F.col("_hit.equipment_id")).otherwise(F.coalesce("_near", "_eq")).alias("equipment_id"), method.alias("asset_match_method"), confidence.alias("asset_match_confidence"), F.col("_key").alias("asset_match_key")))
