"""Stars of tables around a base table, as lists of steps: work orders, locations, task lists, materials.

Steps never multiply rows but where the result has a row for each match: other tables are brought to one row a key before
they are joined, so a key with many lines costs one aggregate, not a product. What meets the base only by the base's own
columns is joined before rows multiply, and the rows of a table that cannot be first are gone before they meet others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.functions.coerce import number
from tagwright.operators import tables as t
from tagwright.operators.joins import join_key, lookup


@dataclass(frozen=True)
class Step:
    """A table to join from the left on columns ``on``; ``rows``: ``all`` matches, the ``first`` (ties by the other columns), their ``sum``, or ``one`` (more fail the query)."""

    table: str
    on: tuple[str, ...]
    rows: str = "all"
    suffix: str = "_r"
    columns: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()
    where: tuple[str, str] | None = None


# Which tables a star has and by which columns they meet.
WORK_ORDER = (
    Step("AFKO", ("AUFNR",)),
    Step("AFVC", ("AUFNR",)),
    Step("QMEL", ("AUFNR",), "first", "_QMEL"),
    Step("QMSM", ("QMNUM",), "first", "_QMSM"),
    Step("JEST", ("OBJNR",), "first"),
    Step("JSTO", ("OBJNR",), "first", "_JSTO"),
    Step("RESB", ("AUFNR",), "sum", "_RESB"),
    Step("COEP", ("AUFNR",), "sum", "_COEP"),
    Step("EQUI", ("EQUNR",), "one", "_EQUI"),
    Step("IFLOT", ("TPLNR",), "one", "_IFLOT"),
    Step("STXH", ("AUFNR",), "first", columns=("TDID",), renamed=(("TDNAME", "AUFNR"),), where=("TDOBJECT", "AUFK")),
    Step("STXL", ("AUFNR",), "first", "_STXL", renamed=(("TDNAME", "AUFNR"),)),
)
OPERATION = (Step("AFVV", ("AUFPL", "VORNR"), "first", columns=("DAUNO_MIN",)),)
LOCATION = (Step("IFLOT", ("TPLNR",), "one", "_IFLOT"), Step("ILOA", ("ILOAN",), "one", "_ILOA"))
TASK_LIST = (Step("MAPL", ("PLNNR", "PLNAL")), Step("PLPO", ("PLNNR",), suffix="_PLPO"), Step("EQUI", ("EQUNR",), "one", "_EQUI"))
ORDER = "seq"


def _numeric(df: DataFrame, but: tuple[str, ...], additive: list[str] | None) -> list[str]:
    kinds = ("int", "bigint", "double", "float", "smallint")
    return [c for c, kind in df.dtypes if c not in (*but, ORDER) and (c in additive if additive is not None else kind in kinds or kind.startswith("decimal"))]


def _side(step: Step, df: DataFrame, additive: list[str] | None) -> DataFrame:
    for old, new in step.renamed:
        df = df.withColumnRenamed(old, new) if old in df.columns else df
    if step.where and step.where[0] in df.columns:
        df = df.where(F.col(step.where[0]) == step.where[1])
    if step.columns:
        df = df.select(*step.on, *[c for c in step.columns if c in df.columns], ORDER)
    return df


@dataclass
class _Met:
    """A step as it will be joined: the cleaned keys ``own`` of ``right``, and ``named``: its other columns with their names in the result."""

    rows: str
    own: tuple[str, ...]
    right: DataFrame
    named: dict[str, str]
    numbers: list[str]


def _planned(base: DataFrame, tables: dict[str, DataFrame], steps: tuple[Step, ...], on: dict[str, list[str]], additive: list[str] | None) -> tuple[list[_Met], list[str]]:
    """The steps that have their tables and columns, and the columns of the result in the steps' order."""
    met, names = [], [c for c in base.columns if c != ORDER]
    for step in steps:
        own = tuple(on.get(step.table, step.on))
        right = tables.get(step.table)
        right = right if right is None else _side(step, right, additive)
        if right is None or any(c not in right.columns or c not in names for c in own):
            continue
        keyed = right.select(*[join_key(c).alias(c) for c in own], *[c for c in right.columns if c not in own])
        named = {c: c + step.suffix if c in names else c for c in keyed.columns if c not in (*own, ORDER)}
        met.append(_Met(step.rows, own, keyed, named, _numeric(keyed, own, additive)))
        names += named.values()
    return met, names


def _needed(met: list[_Met], keys: list[str]) -> set[str]:
    """Columns of the result that say which rows it has: ``keys``, what tables with all their rows meet by, and what these come from."""
    out = set(keys)
    for m in reversed(met):
        if m.rows == "all" or out & set(m.named.values()):
            out |= set(m.own)
    return out


def _in_turn(met: list[_Met]) -> list[int]:
    """The order of joins that moves least: by the base's other keys first, then by the key of the first table with all its rows, then those tables, then what depends on them."""
    main = next((m.own for m in met if m.rows == "all"), None)
    asked, place, stage = {c for m in met for c in m.own}, {}, []
    for m in met:
        after = max((place.get(c, 0) for c in m.own), default=0)
        if m.rows == "all" or after > 2:
            k = 4 if after > 2 else 3
        elif m.own == main:
            k = 1 if asked & set(m.named.values()) else 2
        else:
            k = after
        place |= dict.fromkeys(m.named.values(), k)
        stage.append(k)
    return sorted(range(len(met)), key=lambda k: stage[k])


def _one_a_key(m: _Met) -> DataFrame:
    """The step's table with one row for each of its keys."""
    own = list(m.own)
    if m.rows == "first":
        return t.keep_first(m.right, own, [ORDER])
    if m.rows == "sum":
        return t.collapse(m.right, own, m.numbers, ORDER)
    one = m.right.groupBy(*own).agg(F.count("*").alias("_n"), F.any_value(F.struct(*m.named)).alias("_row"))
    return one.withColumn("_row", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"keys repeat: {own}"))).otherwise(F.col("_row"))).select(*own, "_row.*")


def star(base: DataFrame, tables: dict[str, DataFrame], steps: tuple[Step, ...], keys: list[str], on: dict[str, list[str]] | None = None, additive: list[str] | None = None) -> DataFrame:
    """``base`` with the tables of ``steps``, one row for each of ``keys``: the first by the tables' ``seq`` columns, which go.

    A step is left out where its table is not there or where its columns are not on both sides; ``on`` gives other columns for a table. Columns
    that both sides have stay with the step's suffix. Keys are compared as text without ``.0``. ``sum`` adds numbers (or the
    columns ``additive``, texts with separators too) and takes the first value of other columns.

    Of rows of one table that meet the same rows of all others, only the first can be first in the result: they leave by
    ``keep_first`` before they are joined. Where this makes the result's rows one for each of ``keys``, nothing is left to
    leave at the end, and no wide row moves for it.
    """
    met, names = _planned(base, tables, steps, on or {}, additive)
    out, order, keys = base.withColumnRenamed(ORDER, "_o"), ["_o"], [c for c in keys if c in names]
    needed, sure = _needed(met, keys), False
    if keys and any(m.rows == "all" for m in met):
        own = [c for c in base.columns if c in needed]
        sure = set(own) <= set(keys) and not any(kind in ("float", "double") for c, kind in base.dtypes if c in own)  # 0 and -0 are one key, but two texts
        out = t.keep_first(out, own, order)
    for k in _in_turn(met):
        m, place = met[k], []
        if m.rows == "all":
            right, place = m.right, [F.col(ORDER).alias(f"_o{k}")]
            if keys:
                told = [c for c, name in m.named.items() if name in needed]
                sure = sure and {m.named[c] for c in told} <= set(keys)
                # in the partitions of the join that follows
                right = t.keep_first(right.repartition(*m.own) if told else right, [*m.own, *told], [ORDER])
        elif m.named:
            right = _one_a_key(m)
        elif m.rows == "one" and not keys:
            right = m.right
        else:
            continue
        order += [f"_o{k}"] if place else []
        named = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(m.own)], *[F.col(c).alias(name) for c, name in m.named.items()], *place)
        out = out.join(named, [join_key(c) == F.col(f"_k{i}") for i, c in enumerate(m.own)], "left").drop(*[f"_k{i}" for i in range(len(m.own))])
    if sure or not keys:
        return out.select(*names)
    return t.keep_first(out.select(*names, *sorted(order, key=lambda c: (len(c), c))), keys, sorted(order, key=lambda c: (len(c), c))).select(*names)


def work_orders(tables: dict[str, DataFrame], **options) -> DataFrame:
    """The star of work orders: a row for each order and operation. Operations meet their values by their own plan number, which then goes."""
    base = tables["AUFK"].withColumn("OBJNR", F.concat(F.lit("OR"), F.col("AUFNR").cast("string")))
    if "AFVC" in tables:
        operations = star(tables["AFVC"].withColumn("_seq", F.col(ORDER)), tables, OPERATION, [], **options)
        tables = {**tables, "AFVC": operations.withColumnRenamed("_seq", ORDER).drop("AUFPL")}
    return star(base, tables, WORK_ORDER, ["AUFNR", "VORNR"], **options)


def locations(tables: dict[str, DataFrame], **options) -> DataFrame:
    """Equipment with its location and its address, as many rows as equipment."""
    return star(tables["EQUI"], tables, LOCATION, [], **options)


def task_lists(tables: dict[str, DataFrame], **options) -> DataFrame:
    """Task lists with their equipment and operations: a row for each list, group counter and operation."""
    return star(tables["PLKO"], tables, TASK_LIST, ["PLNNR", "PLNAL", "VORNR"], **options)


def materials(tables: dict[str, DataFrame], resb: list[str], coep: list[str]) -> DataFrame:
    """A row for each material and plant: MARA, MARC and MARD, the first values of each, and the sums of ``resb`` and ``coep`` columns.

    The sums are those over all rows that joining reservations by MATNR, and cost lines by the reservations' AUFNR, to every
    storage location would give: a reservation counts once for each cost line of its order (at least once), and all once for each
    location. They are worked out from counts; that product is never made.
    """
    first = lambda df, keys: df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(ORDER, c))).alias(c) for c in df.columns if c not in (*keys, ORDER)])
    add = lambda c: F.sum(number(c) if isinstance(c, str) else c)
    key = lambda df, *names: df.withColumns({c: join_key(c) for c in names})
    mara, marc, mard = key(tables["MARA"], "MATNR"), key(tables["MARC"], "MATNR", "WERKS"), key(tables["MARD"], "MATNR", "WERKS")
    plants = first(marc, ["MATNR", "WERKS"]).join(marc.groupBy("MATNR", "WERKS").agg(F.count("*").alias("_plants")), ["MATNR", "WERKS"])
    places = first(mard, ["MATNR", "WERKS"]).join(mard.groupBy("MATNR", "WERKS").agg(F.count("*").alias("_places")), ["MATNR", "WERKS"])
    lines = key(tables["COEP"], "AUFNR").groupBy("AUFNR").agg(F.count("*").alias("_lines"), *[add(c).alias(c) for c in coep])
    held = key(tables["RESB"], "MATNR", "AUFNR").groupBy("MATNR", "AUFNR").agg(F.count("*").alias("_held"), *[add(c).alias(c) for c in resb]).join(lines, "AUFNR", "left")
    sums = held.groupBy("MATNR").agg(*[F.sum(F.col(c) * F.coalesce("_lines", F.lit(1))).alias(c) for c in resb], *[F.sum(F.col(c) * F.col("_held")).alias(c) for c in coep])
    sums = sums.withColumn("_met", F.lit(True))
    # a material without reservations has no order, and meets the cost lines that have none
    loose = lines.where("AUFNR = ''").agg(*[F.sum(c).alias(f"_{c}") for c in coep]) if coep else None
    one = lookup(lookup(lookup(first(mara, ["MATNR"]), plants, ["MATNR"], "_MARC"), places, ["MATNR", "WERKS"], "_MARD"), sums, ["MATNR"])
    if coep:
        one = one.join(F.broadcast(loose)).select(*[F.when(F.col("_met"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c in coep else F.col(c) for c in one.columns])  # one row
    copies = F.coalesce("_plants", F.lit(1)) * F.coalesce("_places", F.lit(1))
    return one.select(*[(F.col(c) * copies).alias(c) if c in (*resb, *coep) else F.col(c) for c in one.columns if c not in ("_plants", "_places", "_met")])
