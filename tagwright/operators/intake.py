"""Uploads as they come to rows as they are stored: findings with identity and record ids, tags of two historians' exports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions import coerce, tags
from tagwright.functions.text import equipment_uid, fold_vocabulary, text
from tagwright.operators import entities, identity
from tagwright.operators import tables as t

# How long a record id may be, and how much of its digest stands behind one that is cut.
LONGEST_ID, DIGEST = 180, 12


def key_part(c: str, kind: str = "string") -> Column:
    """One part of a natural key: of times the day, of texts no missing-value words, no ``.0`` behind digits, no midnight behind a date."""
    if kind.startswith("timestamp"):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    v = text(F.col(c))
    v = F.when(F.lower(v).isin("nan", "nat", "none", "null"), "").when(v.rlike(r"^[0-9]+\.0+\z"), F.substring_index(v, ".", 1)).otherwise(v)
    return F.when((F.length(v) == 19) & (F.substring(v, 5, 1) == "-") & F.endswith(v, F.lit("00:00:00")), F.substring(v, 1, 10)).otherwise(v)


def bounded(c: Column) -> Column:
    """A key within LONGEST_ID characters; a longer one ends in a digest of all of it."""
    short = F.concat(F.substring(c, 1, LONGEST_ID - DIGEST - 1), F.lit("~"), F.substring(F.sha1(c), 1, DIGEST))
    return F.when(F.length(c) <= LONGEST_ID, c).otherwise(short)


def record_ids(df: DataFrame, keys: list[str], file: str, order: str, out: str = "source_record_id") -> DataFrame:
    """``df`` with a natural key for each row of a file: its parts with bars between, ``row-n`` (n: ``order``) where it is blank, ``#k`` behind the k-th row of one key."""
    kinds = dict(df.dtypes)
    joined = F.regexp_replace(F.concat_ws("|", *[key_part(k, kinds[k]) if k in kinds else F.lit("") for k in keys]), r"^\|+|\|+\z", "")
    own = F.coalesce(F.nullif(bounded(joined), F.lit("")), F.concat(F.lit("row-"), F.col(order).cast("string")))
    rows = df.withColumn("_own", own)
    n = F.row_number().over(Window.partitionBy(file, "_own").orderBy(order))
    return rows.withColumn(out, F.when(n == 1, F.col("_own")).otherwise(bounded(F.concat("_own", F.lit("#"), n.cast("string"))))).drop("_own")


@dataclass(frozen=True)
class Findings:
    """A connector's template: headers that mean a column, its types (number, integer, date, boolean), raw values to keep, words to fold, natural key, identity columns."""

    connector: str
    headers: dict[str, list[str]]
    kinds: dict[str, str] = field(default_factory=dict)
    raw: dict[str, str] = field(default_factory=dict)
    words: dict[str, dict[str, str]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    natural_key: tuple[str, ...] = ()
    sap: tuple[str, ...] = ()
    equipment: tuple[str, ...] = ()
    flocs: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()


COERCE = {"number": coerce.first_number, "integer": lambda c: coerce.first_number(c).cast("long"), "date": coerce.timestamp, "boolean": coerce.truth}


def findings(df: DataFrame, spec: Findings, plant: str, known: DataFrame, pid: DataFrame | None = None, batch: str = "") -> tuple[DataFrame, dict[str, list[str]]]:
    """Stored rows of uploaded findings and the report on their headers; ``df`` has ``source_file`` and ``seq`` beside the columns of its upload.

    Headers become columns (see ``entities.map_headers``) and others go; values take their kinds, other texts their controlled words; the identity
    ladder names the asset. ``asset_mapped`` says whether ``known`` (asset) has it. With ``pid`` (tag, seq) a row's equipment is the
    diagrams' spelling of its asset, which then is the asset, and blank where they don't know it. An upload that lacks a required column is an error.
    """
    rows, report = entities.map_headers(df.drop("source_file", "seq"), spec.headers, list(spec.required))
    if report["missing"]:
        raise ValueError(f"missing required column(s): {', '.join(report['missing'])}")
    names = {c: f for c, f in zip(report["mapped"], rows.columns)}
    rows = df.select(*[F.col(f"`{c}`").alias(f) for c, f in names.items()], "source_file", "seq")
    kept = {new: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c, new in spec.raw.items() if c in rows.columns}
    rows = rows.withColumns(kept) if kept else rows
    typed = {c: COERCE[kind](F.col(c)) for c, kind in spec.kinds.items() if c in rows.columns and kind in COERCE}
    typed |= {c: fold_vocabulary(c, words) for c, words in spec.words.items() if c in rows.columns and c not in typed}
    rows = rows.withColumns(typed) if typed else rows
    there = lambda columns: tuple(c for c in columns if c in rows.columns)
    rows = identity.findings(rows, there(spec.sap), there(spec.equipment), there(spec.flocs), there(spec.texts))
    ids = known.select(F.upper(F.trim("asset")).alias("_asset")).where("_asset <> ''").distinct()
    rows = rows.join(ids, F.upper(F.trim("normalized_asset")) == F.col("_asset"), "left").withColumn("asset_mapped", F.col("_asset").isNotNull()).drop("_asset")
    rows = record_ids(rows, list(spec.natural_key), "source_file", "seq")
    rows = rows.withColumns({"plant_code_id": F.lit(plant), "source_system": F.lit(spec.connector.upper()), "upload_batch_id": F.lit(batch), "confidence": F.col("asset_match_confidence"), "is_active": F.lit(True), "equipment_uid": equipment_uid(F.lit(plant), "normalized_asset")})
    if pid is not None:
        rows = identity.on_diagram(rows, "normalized_asset", pid, "tag", "seq")
        rows = rows.withColumns({"equipment_id": F.when(F.col("pid_matched"), F.col("pid_asset")).otherwise(""), "normalized_asset": F.when(F.col("pid_matched"), F.col("pid_asset")).otherwise(F.col("normalized_asset"))}).drop("pid_matched", "pid_asset", "pid_confidence")
    return rows, report


@dataclass(frozen=True)
class Export:
    """Where a historian's export has paths and names, which place of a path is what, and where a tag may link."""

    path: str = "Parent"
    separator: str = "\\"
    levels: dict[str, int] = field(default_factory=dict)
    preference: tuple[str, ...] = ()
    confidence: dict[str, float] = field(default_factory=dict)


def _leveled(df: DataFrame, spec: Export) -> DataFrame:
    """``df`` with ``hier_`` columns, asset_link_level and asset_link_confidence."""
    if not spec.levels or spec.path not in df.columns:
        return df
    parts = tags.hierarchy(spec.path, spec.separator)
    named = {f"hier_{name}": F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for name, k in spec.levels.items()}
    link = tags.deepest_level(parts, spec.levels, list(spec.preference), spec.confidence)
    return df.withColumns({**named, "asset_link_level": link["level"], "asset_link_confidence": link["confidence"]})


def pi_tags(df: DataFrame, spec: Export, depth: int, point: str = "AttributeConfigString", point_separator: str = ".", name: str | None = None) -> DataFrame:
    """Rows of a PI export with equipment_id, pi_tag_id, pi_state, levels and ``tag_name``, a stable key.

    The equipment is the last segment of a path of at least ``depth``; tag and state are the last two parts of the point reference; the key is both, or
    the tag alone, or the column ``name`` where there is neither; rows that share one get a digest of their values behind it.
    """
    out = df.withColumn("equipment_id", tags.at_depth(tags.hierarchy(spec.path, spec.separator), depth)) if spec.path in df.columns and depth else df
    if point in out.columns:
        ref = tags.point_reference(point, point_separator)
        out = out.withColumns({"pi_tag_id": ref["tag"], "pi_state": ref["attribute"]})
    else:
        out = out.withColumns({"pi_tag_id": F.lit(None).cast("string"), "pi_state": F.lit(None).cast("string")})
    both = F.when(F.col("pi_tag_id").isNotNull() & F.col("pi_state").isNotNull(), F.concat("pi_tag_id", F.lit(point_separator), "pi_state")).otherwise(F.coalesce("pi_tag_id", F.lit("")))
    fallback = text(name) if name and name in df.columns else F.lit("")
    out = _leveled(out.withColumn("_base_key", F.coalesce(F.nullif(both, F.lit("")), fallback)), spec)
    return t.stable_keys(out, "_base_key", "tag_name").drop("_base_key")


def protean_tags(df: DataFrame, spec: Export, index: int, name: str = "Name", excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a PROTEAN export, all sheets together, with equipment_id (the segment at ``index``), levels and ``tag_name``, a stable key of equipment and name.

    Rows of ``excluded`` object types and rows without path and name go.
    """
    if "ObjectType" in df.columns and excluded:
        df = df.where(~F.lower(text("ObjectType")).isin(*[x.strip().lower() for x in excluded]))
    df = df.where((text(spec.path) != "") | (text(name) != ""))
    out = df.withColumn("equipment_id", F.get(tags.hierarchy(spec.path, spec.separator), F.lit(index)))
    parts = F.filter(F.array(text("equipment_id"), text(name)), lambda x: (x != "") & (x != "nan"))
    out = _leveled(out.withColumn("_base_key", F.array_join(parts, ".")), spec)
    return t.stable_keys(out, "_base_key", "tag_name").drop("_base_key")
