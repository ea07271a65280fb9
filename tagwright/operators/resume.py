"""Extraction that goes on where it broke off: which chunks of which files are to be done, and what becomes of the rows of earlier runs.

A ledger (file, n_chunks, failed) says of each file how many chunks it had and which of them were lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.pages import pages_label


def _state(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """file, now (chunks today), n_chunks and failed as recorded; files that are there today."""
    now = chunks.groupBy("file").agg(F.count("*").alias("now"))
    return now.join(ledger.select("file", "n_chunks", "failed"), "file", "left")


def to_do(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Of ``chunks`` (file, chunk, ...) those to extract: all of a file that is new or whose number of chunks changed, else the lost ones alone.

    A file that the ledger knows with as many chunks and none lost is done. Recorded numbers of chunks that aren't there are
    passed over. The ledger has a file once; columns of ``chunks`` stay.
    """
    state = _state(chunks, ledger).select("file", (F.col("n_chunks").isNull() | (F.col("n_chunks") != F.col("now"))).alias("_all"), F.col("failed").alias("_failed"))
    rows = chunks.join(state, "file").where(F.col("_all") | F.coalesce(F.array_contains("_failed", F.col("chunk")), F.lit(False)))
    return rows.select(*chunks.columns)


def merged(old: DataFrame, new: DataFrame, done: DataFrame, chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows (file, chunk, ...) after a run: earlier rows but those of chunks done again (``done``: file, chunk) and of files whose number of chunks changed, and the new ones.

    Rows of files that are not there today stay.
    """
    changed = _state(chunks, ledger).where("n_chunks <> now").select("file")
    kept = old.join(changed, "file", "left_anti").join(done.select("file", "chunk").distinct(), ["file", "chunk"], "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def new_ledger(chunks: DataFrame, done: DataFrame, ledger: DataFrame) -> DataFrame:
    """file, n_chunks, failed after a run: of chunks in ``done`` (file, chunk, ok) the lost ones, in order; files not touched keep their entry."""
    lost = done.groupBy("file").agg(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("chunk")))).alias("failed"))
    now = chunks.groupBy("file").agg(F.count("*").alias("n_chunks")).join(lost, "file")
    return ledger.select("file", "n_chunks", "failed").join(now, "file", "left_anti").unionByName(now)


# Columns that can hold a row's equipment tag, in this order, and how ids are made.
TAG_COLUMNS = ("Equipment_Tag", "Equipment Tag", "Equipment Name", "Tag No.", "Tag Name", "Tag", "Equipment ID", "equipment_no")
DOCUMENT_ID, RECORD_ID = ("DOC", 20), ("REC", 16)


def _id(kind: tuple[str, int], *parts: Column) -> Column:
    stem = F.regexp_replace("file", r"(?<=.)\.[^.]*\z", "")
    digest = F.substring(F.sha1(F.concat_ws("|", "file", "document_type", *parts)), 1, 12)
    return F.upper(F.concat(F.lit(f"{kind[0]}-"), F.replace(F.substring(stem, 1, kind[1]), F.lit(" "), F.lit("_")), F.lit("-"), digest))


def _records(rows: DataFrame, place: Column, tags: tuple[str, ...]) -> DataFrame:
    value = lambda k: F.trim(F.coalesce(F.try_element_at("values", F.lit(k)), F.lit("")))
    said = lambda v: ~F.lower(F.trim(F.coalesce(v, F.lit("")))).isin("", "nan", "none")
    tag = F.coalesce(*[F.when(said(value(k)), value(k)) for k in tags], F.lit(""))
    told = F.filter(F.map_entries("values"), lambda x: said(x["value"]))
    entities = F.array_join(F.transform(told, lambda x: F.concat(x["key"], F.lit(": "), F.trim(x["value"]))), " | ")
    return rows.withColumns({"document_id": _id(DOCUMENT_ID), "record_id": _id(RECORD_ID, F.concat(F.lit("row"), place)), "equipment_tag": tag, "extracted_entities": entities})


def record_rows(entries: DataFrame, tags: tuple[str, ...] = TAG_COLUMNS) -> DataFrame:
    """Rows of what was read in chunks: ``entries`` (file, document_type, chunk, position, page_start, page_end, values map), one for each entry with a value.

    ``position`` becomes the entry's place, from 0, among those of its chunk that have a value. document_id is made from file and type,
    record_id from these, chunk and place; ``equipment_tag`` is the first of the columns ``tags`` that says one; ``extracted_entities`` are
    ``name: value`` with bars between, in the order of the map; missing-value words are none. ``source_pages`` are the pages as text.
    """
    filled = entries.where(F.exists(F.map_values(F.coalesce("values", F.create_map().cast("map<string,string>"))), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""))
    place = F.row_number().over(Window.partitionBy("file", "document_type", "chunk").orderBy("position")) - 1
    rows = filled.withColumn("position", place)
    out = _records(rows, F.concat(F.col("chunk").cast("string"), F.lit("."), F.col("position").cast("string")), tags)
    return out.select("document_id", "record_id", "file", "document_type", "chunk", "position", "equipment_tag", "extracted_entities", "page_start", "page_end", pages_label("page_start", "page_end").alias("source_pages"))


def tabular_rows(cells: DataFrame, wanted: list[str], tags: tuple[str, ...] = TAG_COLUMNS) -> DataFrame:
    """Rows of tables: ``cells`` (file, document_type, sheet, ordinal, idx, values map), one for each row of a sheet, blank ones too.

    Of the values those of the columns ``wanted`` are told, in that order; the tag may come from any column. record_id is made from the sheet
    and the row's place in it (its place alone where there is no sheet); ``source_pages`` is the sheet's name, 40 letters at most.
    """
    sheet, idx = F.coalesce("sheet", F.lit("")), F.col("idx").cast("string")
    place = F.when(sheet != "", F.concat(sheet, F.lit("!"), idx)).otherwise(idx)
    own = F.transform(F.array(*map(F.lit, wanted)), lambda k: F.struct(k.alias("key"), F.try_element_at("values", k).alias("value")))
    tagged = _records(cells, place, tags).withColumnRenamed("equipment_tag", "_tag").withColumn("values", F.map_from_entries(own))
    out = _records(tagged, place, tags)
    return out.select("document_id", "record_id", "file", "document_type", F.col("ordinal").alias("chunk"), F.col("_tag").alias("equipment_tag"), "extracted_entities", F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), F.substring(sheet, 1, 40).alias("source_pages"))
