"""Canonical entities from source tables: columns by template, standard fields, packed attributes, readable names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.tags import clean_description
from tagwright.functions.text import entity_uid, is_blank, non_blank, text
from tagwright.operators.tables import header_key

# Systems by source, columns that can tell the plant, and what a record's id is made of, in this order.
SYSTEMS = {"timeseries": "TS", "safety_limits": "TS", "pid": "PID", "documents": "DOCS", "fmea": "FMEA", "standards": "STANDARDS"}
PLANT_COLUMNS = ("plant_code_id", "WERKS", "IWERK", "SWERK", "BUKRS")
RECORD_KEYS = ("plant_code_id", "tag_name", "wo_number", "AUFNR", "QMNUM", "equipment_id", "EQUNR", "functional_location", "TPLNR", "task_list_id", "PLNNR", "material_code", "MATNR", "document_id")


def with_copies(df: DataFrame, copies: dict[str, str]) -> DataFrame:
    """Columns under a second name (name -> column) where that name is free."""
    return df.withColumns({new: F.col(old) for new, old in copies.items() if old in df.columns and new not in df.columns})


def map_headers(df: DataFrame, aliases: dict[str, list[str]], required: list[str] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """Columns renamed to the fields whose aliases they are, the first header of a field winning, and what was mapped, unmapped and missing."""
    index = {header_key(a): field for field, names in aliases.items() for a in [field, *names]}
    taken: dict[str, str] = {}
    for c in df.columns:
        if (field := index.get(header_key(c))) and field not in taken.values():
            taken[c] = field
    report = {"mapped": list(taken), "unmapped": [c for c in df.columns if c not in taken], "missing": [f for f in required if f not in taken.values()]}
    return df.select(*[F.col(f"`{c}`").alias(f) for c, f in taken.items()]), report


def derived(df: DataFrame, source: str, plant: str | None = None, now: str = "1970-01-01 00:00:00") -> DataFrame:
    """``df`` with plant_code_id, ingested_at, updated_at, source_system and source_record_id where it lacks them.

    The plant is the argument's, else each row's first non-blank of PLANT_COLUMNS, else ``UNKNOWN``; a blank one is filled.
    """
    own = [non_blank(c) for c in PLANT_COLUMNS if c in df.columns]
    default = F.lit(plant) if plant else F.coalesce(*own, F.lit("UNKNOWN"))
    code = F.coalesce(non_blank("plant_code_id"), default) if "plant_code_id" in df.columns else default
    out = df.withColumn("plant_code_id", code)
    stamps = {c: F.lit(now).cast("timestamp") for c in ("ingested_at", "updated_at") if c not in df.columns}
    system = {} if "source_system" in df.columns else {"source_system": F.lit(SYSTEMS.get(source, "SAP"))}
    keys = [k for k in RECORD_KEYS if k in out.columns]
    record = {} if "source_record_id" in df.columns else {"source_record_id": F.sha1(F.concat_ws("|", *map(text, keys)))}
    return out.withColumns(stamps | system | record)


def build(sources: dict[str, DataFrame], schema: dict[str, str], attributes: dict[str, list[str]], keys: list[str], pk: str, prefix: str, plant: str, extras: list[str] | None = None) -> DataFrame:
    """One entity table: the rows of the first source, each column of ``schema`` from the first of its ``source.column``
    references whose column the base has.

    Rows with a blank identity key go, then repeated rows. A blank primary key becomes the keys' uid; ``confidence`` and
    ``is_active`` default to 1. The base's other columns follow, or those of them in ``extras``.
    """
    base_name = next(iter(sources))
    base = sources[base_name].withColumn("plant_code_id", F.lit(plant)) if "plant_code_id" in sources[base_name].columns else sources[base_name]

    def value(c: str) -> Column:
        refs = [r.partition(".")[2] for r in attributes.get(c, []) if r.partition(".")[0] == base_name]
        found = next((x for x in refs if x in base.columns), None)
        if c == "plant_code_id":
            return F.lit(plant)
        return F.col(found) if found else F.lit(None)

    columns = {c: text(value(c)) if c in keys else value(c).try_cast(t) for c, t in schema.items()} | {k: text(value(k)) for k in keys if k not in schema}
    more = [c for c in base.columns if c not in columns and (extras is None or c in extras)]
    out = base.select(*[v.alias(c) for c, v in columns.items()], *more)
    for k in keys:
        out = out.where(F.col(k) != "")
    defaults = {c: F.coalesce(c, F.lit(1).cast(schema[c])) for c in ("confidence", "is_active") if c in schema}
    uid = {pk: F.coalesce(non_blank(pk), entity_uid(prefix, *keys)) if pk in out.columns else entity_uid(prefix, *keys)}
    return out.dropDuplicates().withColumns(defaults | uid)


def packed(df: DataFrame, prefixes: list[str], out: str = "source_attributes") -> DataFrame:
    """``df`` with one JSON text a row of the non-blank columns that begin with each prefix, by source and name, in order; empty where none."""
    blocks = []
    for p in sorted(prefixes):
        own = sorted(c for c in df.columns if c.startswith(p))
        if own:
            entries = F.filter(F.array(*[F.struct(F.lit(c.removeprefix(p)).alias("key"), non_blank(c).alias("value")) for c in own]), lambda e: e["value"].isNotNull())
            blocks.append(F.struct(F.lit(p.rstrip("_")).alias("key"), F.map_from_entries(entries).alias("value")))
    if not blocks:
        return df.withColumn(out, F.lit(""))
    held = F.filter(F.array(*blocks), lambda b: F.size(b["value"]) > 0)
    return df.withColumn(out, F.when(F.size(held) > 0, F.to_json(F.map_from_entries(held))).otherwise(""))


def readable(df: DataFrame, key: str, names: DataFrame, name_key: str, description: str, out: str) -> DataFrame:
    """``df`` with ``out`` right after ``key``: the key's description in a form for people and the key in brackets; the key alone without one."""
    best = names.select(F.upper(text(name_key)).alias("_k"), clean_description(description).alias("_d")).where("_k <> '' and _d <> ''").groupBy("_k").agg(F.min("_d").alias("_d"))
    named = df.join(best, F.upper(text(key)) == F.col("_k"), "left")
    at = df.columns.index(key) + 1
    value = F.coalesce(F.concat("_d", F.lit(" ("), F.col(key), F.lit(")")), F.col(key).cast("string")).alias(out)
    return named.select(*df.columns[:at], value, *df.columns[at:])


def ontology_uid(c: str) -> Column:
    """An id that is no number, to be kept beside the number that replaces it."""
    return F.when(~is_blank(c) & ~text(c).rlike("^[0-9]+$"), text(c))


def with_plant(df: DataFrame, plant: str) -> DataFrame:
    """The plant on every row, and ``-`` for a blank site."""
    site = F.coalesce(non_blank("site"), F.lit("-")) if "site" in df.columns else F.lit("-")
    return df.withColumns({"plant_code_id": F.lit(plant), "site": site})


def tag_metadata(df: DataFrame, tag: str, order: str, description: str, uom: str, low: str, high: str, confidence: str, source: str) -> DataFrame:
    """One row a tag: first description, first non-blank unit, lowest and highest limit, best confidence, sources joined in order."""
    return df.groupBy(tag).agg(
        F.min_by(description, F.when(F.col(description).isNotNull(), F.col(order))).alias(description),
        F.min_by(non_blank(uom), F.when(~is_blank(uom), F.col(order))).alias(uom),
        F.min(low).alias(low),
        F.max(high).alias(high),
        F.max(confidence).alias(confidence),
        F.array_join(F.array_sort(F.collect_set(non_blank(source))), " | ").alias(source),
    )
