"""Relationships between entities by definition: one way of building them for every definition."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.text import text
from tagwright.operators import tables as t

ORDER = "seq"


@dataclass(frozen=True)
class Entity:
    """``keys`` name an entity, ``uid`` is the column of its id; where a source lacks a key, ``columns`` says (key -> source -> column) where it stands."""

    keys: tuple[str, ...]
    uid: str
    columns: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Definition:
    name: str
    source: str
    rel_type: str
    parent: str
    child: str
    distinct: tuple[str, ...] = ()


# The relationships of the model, the tables they are read from and what makes a row of these one relationship.
DEFINITIONS = (
    Definition("pid_connectivity", "pid", "FLOW", "equipment", "equipment", ("plant_code_id", "from_equipment_ref", "to_equipment_ref", "connection_type")),
    Definition("equipment_to_floc", "sap_assets", "LOCATED_AT", "equipment", "functional_location", ("plant_code_id", "normalized_asset", "floc")),
    Definition("equipment_to_process_unit", "pid", "PART_OF_PROCESS_UNIT", "equipment", "process_unit", ("plant_code_id", "normalized_asset", "process_unit_code")),
    Definition("wo_to_equipment", "sap_wo", "EXECUTED_ON", "work_order", "equipment", ("plant_code_id", "wo_number", "normalized_asset")),
    Definition("notif_to_equipment", "sap_notification", "REPORTED_ON", "notification", "equipment", ("plant_code_id", "notification_id", "normalized_asset")),
    Definition("task_list_to_equipment", "sap_task_list", "APPLIES_TO", "task_list", "equipment", ("plant_code_id", "task_list_id", "operation_no", "normalized_asset")),
    Definition("plan_to_equipment", "sap_maintenance_plan", "SCHEDULES", "maintenance_plan", "equipment", ("plant_code_id", "plan_id", "normalized_asset")),
    Definition("equipment_has_bom_item", "sap_bom", "HAS_BOM_ITEM", "equipment", "bom_item", ("plant_code_id", "normalized_asset", "bom_id", "item_no")),
    Definition("bom_item_is_material", "sap_bom", "IS_MATERIAL", "bom_item", "material", ("plant_code_id", "bom_id", "item_no", "material_code")),
    Definition("po_to_vendor", "sap_po", "PURCHASED_FROM", "purchase_order", "vendor", ("po_number", "po_item", "vendor_code")),
    Definition("po_to_material", "sap_po", "ORDERS_MATERIAL", "purchase_order", "material", ("po_number", "po_item", "material_code")),
    Definition("gr_to_po", "sap_gr", "RECEIPT_AGAINST", "goods_receipt", "purchase_order", ("gr_number", "gr_item", "po_number", "po_item")),
    Definition("invoice_to_po", "sap_invoice", "INVOICED_AGAINST", "invoice", "purchase_order", ("invoice_number", "invoice_item", "po_number", "po_item")),
    Definition("equipment_timeseries", "timeseries", "HAS_TAG", "equipment", "timeseries_metadata", ("plant_code_id", "normalized_asset", "tag_name")),
    Definition("equipment_document", "documents", "HAS_DOCUMENT", "equipment", "document", ("plant_code_id", "normalized_asset", "document_id")),
)


def clean(c: str) -> Column:
    """Trimmed text; missing-value words are empty."""
    return F.when(F.lower(text(c)).isin("nan", "none", "nat"), "").otherwise(text(c))


def _ids(df: DataFrame, entity: Entity, side: str) -> DataFrame:
    """Keys and id of an entity's rows; of rows with one key the last by ``seq``, rows with a blank key or no id are none."""
    keys = [text(k).alias(f"_{side}{i}") for i, k in enumerate(entity.keys)]
    rows = df.where(F.col(entity.uid).isNotNull()).select(*keys, F.col(entity.uid).alias(f"{side}_ref"), ORDER)
    names = [f"_{side}{i}" for i in range(len(keys))]
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(n) != "" for n in names]))
    return rows.groupBy(*names).agg(F.max_by(f"{side}_ref", ORDER).alias(f"{side}_ref"))


def _column(d: Definition, df: DataFrame, e: Entity, k: str) -> str | None:
    """The source's column of an entity's key."""
    column = k if k in df.columns else e.columns.get(k, {}).get(d.source)
    return column if column in df.columns else None


def _keyed(d: Definition, df: DataFrame, columns: dict[str, str | None]) -> bool:
    """Whether what makes one relationship are just the keys of its ends, as texts or whole numbers, and its record id is made from these."""
    kinds = dict(df.dtypes)
    plain = all(kinds.get(c) in ("string", "bigint", "int", "smallint", "tinyint") for c in columns.values())
    return plain and {*columns.values()} == {*d.distinct} and "source_record_id" not in df.columns


def _told_apart(df: DataFrame, names: tuple[str, ...]) -> bool:
    """Whether no text holds the bar that joins them: then different keys have different record ids."""
    texts = [c for c, kind in df.dtypes if c in names and kind == "string"]
    return not texts or df.where(reduce(lambda a, b: a | b, [F.contains(F.col(c), F.lit("|")) for c in texts])).isEmpty()


def _related(d: Definition, df: DataFrame, entities: dict[str, Entity], tables: dict[str, DataFrame]) -> tuple[DataFrame, bool] | None:
    """The relationships of one definition, and whether no two of them can be alike."""
    parent, child = entities[d.parent], entities[d.child]
    if any(c not in tables[n].columns for n, e in ((d.parent, parent), (d.child, child)) for c in (*e.keys, e.uid)):
        return None
    columns = {f"_{side}{i}": _column(d, df, e, k) for side, e in (("parent", parent), ("child", child)) for i, k in enumerate(e.keys)}
    one = [c for c in d.distinct if c in df.columns]
    used = {*one, *columns.values(), "plant_code_id", "source_system", "source_record_id", "confidence", ORDER}
    df = df.select(*[F.trim(c).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes if c in used])
    ends = {n: clean(c) if c else F.lit("") for n, c in columns.items()}
    keyed = _keyed(d, df, columns)
    apart = keyed and _told_apart(df, d.distinct)
    if keyed:
        # rows meet their parents where their first one is found: both want the rows of a parent in one place
        parents = [n for n in ends if n.startswith("_parent")]
        rest = [c for c in df.columns if c not in one]
        rows = df.select(*[e.alias(n) for n, e in ends.items()], *rest).where(reduce(lambda a, b: a & b, [F.col(n) != "" for n in ends]))
        rows = t.keep_first(rows.repartition(*parents), list(ends), [ORDER])
        said = [F.col(next(n for n, c in columns.items() if c == x)) for x in d.distinct]
    else:
        rows = (t.keep_first(df, one, [ORDER]) if one else df).withColumns(ends)
        said = [clean(c) if c in df.columns else F.lit("") for c in d.distinct]
    plant = clean("plant_code_id") if "plant_code_id" in rows.columns else F.col("_parent0")
    own = F.nullif(clean("source_record_id"), F.lit("")) if "source_record_id" in rows.columns else F.lit(None).cast("string")
    said = said or [plant, F.lit(d.name), *map(F.col, ends)]
    made = F.concat(F.lit(f"{d.source}_{d.name}:"), F.sha1("_said"))
    rows = rows.select(
        *ends,
        plant.alias("plant_code_id"),
        (clean("source_system") if "source_system" in rows.columns else F.lit("SAP")).alias("source_system"),
        own.alias("_own"),
        F.when(own.isNull(), F.concat_ws("|", *said)).alias("_said"),  # its digest is longer and comes after the joins
        (F.col("confidence").cast("double") if "confidence" in rows.columns else F.lit(0.8)).alias("confidence"),
    ).where("plant_code_id <> ''")
    for side, e, name in (("parent", parent, d.parent), ("child", child, d.child)):
        rows = rows.join(_ids(tables[name], e, side), [f"_{side}{i}" for i in range(len(e.keys))])
    uid = F.concat(F.lit("rel:"), F.sha1(F.concat_ws("|", "plant_code_id", F.lit(d.rel_type), "parent_ref", "child_ref")))
    return rows.select(uid.alias("relationship_uid"), "plant_code_id", "parent_ref", "child_ref", F.lit(d.rel_type).alias("relationship_type"), "source_system", F.coalesce("_own", made).alias("source_record_id"), "confidence"), apart


def relationships(sources: dict[str, DataFrame], entities: dict[str, Entity], tables: dict[str, DataFrame], definitions: tuple[Definition, ...] = DEFINITIONS) -> DataFrame | None:
    """relationship_uid, plant_code_id, parent_ref, child_ref, relationship_type, source_system, source_record_id, confidence.

    Each definition reads its ``sources`` table (with ``seq``), keeps the first row of what makes one relationship, and looks both ends up
    among the entities' ``tables``; rows with a blank key, an unknown end or no plant give nothing. Without a column of its own a row is
    of system SAP, of confidence 0.8, and its record id is made from what makes it one. Definitions whose source, entities or key columns
    are missing are left out; with none left there is no table (None). Rows of different types are never alike; rows of one type are made
    distinct but where their keys alone tell them apart.
    """
    by_type: dict[str, list[tuple[DataFrame, bool]]] = {}
    for d in definitions:
        if d.source in sources and d.parent in entities and d.child in entities and d.parent in tables and d.child in tables:
            part = _related(d, sources[d.source], entities, tables)
            if part is not None:
                by_type.setdefault(d.rel_type, []).append(part)
    parts = [same[0][0] if len(same) == 1 and same[0][1] else reduce(DataFrame.unionByName, [p for p, _ in same]).distinct() for same in by_type.values()]
    return reduce(DataFrame.unionByName, parts) if parts else None


def unresolved(tables: dict[str, DataFrame], keys: tuple[tuple[str, str, str, str], ...], most: float = 50.0) -> DataFrame:
    """child, column, parent, referring, unresolved, unresolved_pct, status of each foreign key ``keys`` (child, column, parent, column).

    A reference is blank, or is text that a parent has; above ``most`` percent without one warns. Keys whose tables or columns are missing are SKIPPED.
    """
    parts = []
    for child, column, parent, other in keys:
        name = F.lit(child).alias("child"), F.lit(column).alias("column"), F.lit(parent).alias("parent")
        if child not in tables or parent not in tables or column not in tables[child].columns or other not in tables[parent].columns:
            some = next(iter(tables.values()))
            parts.append(some.sparkSession.range(1).select(*name, F.lit(0).cast("long").alias("referring"), F.lit(0).cast("long").alias("unresolved"), F.lit(0.0).alias("unresolved_pct"), F.lit("SKIPPED").alias("status")))
            continue
        n = tables[child].select(clean(column).alias("_k")).where("_k <> ''").groupBy("_k").agg(F.count("*").alias("n"))
        ids = tables[parent].select(clean(other).alias("_id")).where("_id <> ''").distinct()
        g = n.join(ids, F.col("_k") == F.col("_id"), "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("referring"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("n"))), F.lit(0)).alias("unresolved"))
        pct = F.round(F.when(F.col("referring") > 0, F.col("unresolved") / F.col("referring") * 100).otherwise(0.0), 2)
        parts.append(g.select(*name, "referring", "unresolved", pct.alias("unresolved_pct"), F.when(pct > most, "WARN").otherwise("PASS").alias("status")))
    return reduce(DataFrame.unionByName, parts)
