"""What a table's first rows say: where the header is, which source or table it is, what a file holds. Only those rows are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.functions.text import text

SCANNED = 15  # rows in which a header may stand
LEAST_OVERLAP = 0.25  # of a table's expected columns
# First bytes of files.
ZIP, PDF, OLE = "504B0304", "25504446", "D0CF11E0A1B11AE1"


def header_name(c: Column) -> Column:
    return F.replace(F.replace(F.lower(text(c)), F.lit("\n"), F.lit(" ")), F.lit("_"), F.lit(" "))


def header_row(rows: DataFrame, wanted: list[str], by: str = "file", place: str = "row", cells: str = "cells") -> DataFrame:
    """by, row, matched, filled: of each file's first SCANNED rows the one with the most wanted headers, then the most filled cells, then the first."""
    names = F.array_distinct(F.filter(F.transform(cells, header_name), lambda x: x != ""))
    matched = F.size(F.array_intersect(names, F.array(*[F.lit(w.strip().lower().replace("_", " ")) for w in wanted])))
    filled = F.size(F.filter(cells, lambda x: ~F.lower(text(x)).isin("", "nan")))
    scored = rows.where(F.col(place) < SCANNED).select(by, place, matched.alias("matched"), filled.alias("filled"))
    return scored.groupBy(by).agg(F.max_by(F.struct(place, "matched", "filled"), F.struct("matched", "filled", -F.col(place))).alias("best")).select(by, "best.*")


def detected_source(rows: DataFrame, sources: dict[str, list[str]], by: str = "file", place: str = "row", cells: str = "cells") -> DataFrame:
    """by, source, n_sources: the source all of whose headers stand in one of a file's first rows; null where none or several do."""
    names = F.transform(cells, header_name)
    hits = F.filter(F.array(*[F.when(F.forall(F.array(*[F.lit(h.lower().replace("_", " ")) for h in headers]), lambda h: F.array_contains(names, h)), F.lit(name)) for name, headers in sources.items()]), lambda x: x.isNotNull())
    found = rows.where(F.col(place) < SCANNED).groupBy(by).agg(F.array_distinct(F.flatten(F.collect_list(hits))).alias("found"))
    return found.select(by, F.when(F.size("found") == 1, F.get("found", F.lit(0))).alias("source"), F.size("found").alias("n_sources"))


def detected_table(files: DataFrame, tables: dict[str, list[str]], name: str = "file", columns: str = "columns") -> DataFrame:
    """name, table, score of each file by its columns: the table with the largest share of expected columns, of at least two and a
    share of LEAST_OVERLAP; null where several are best."""
    held = F.transform(columns, lambda x: F.upper(text(x)))
    scores = F.array(*[F.struct((F.size(F.array_intersect(held, F.array(*[F.lit(c.upper()) for c in set(cols)]))) / len(set(cols))).alias("score"), F.lit(t).alias("table")) for t, cols in tables.items() if len(set(cols)) > 1])
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    best = F.filter(scores, lambda s: s["score"] == top)
    known = (top >= LEAST_OVERLAP) & (F.size(best) == 1)
    return files.select(name, F.when(known, F.get(best, F.lit(0))["table"]).alias("table"), F.round(top, 4).alias("score"))


def blocks(rows: DataFrame, by: str, place: str, marker: str, value: str) -> DataFrame:
    """by, block, place, value: marker rows (a filled ``marker``) behind a file's first one, each with the one value of the rows
    below it up to the next; a block with several values fails the query. A file's rows are ordered in one task, which reads them in turn."""
    filled = text(marker) != ""
    numbered = rows.withColumn("block", F.count_if(filled).over(Window.partitionBy(by).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    below = F.when(~filled & (text(value) != ""), text(value))
    g = numbered.where("block > 1").groupBy(by, "block").agg(F.min(F.when(filled, F.col(place))).alias(place), F.min(below).alias("_low"), F.max(below).alias("_high"))
    one = F.when(F.col("_low") != F.col("_high"), F.raise_error(F.concat(F.lit("several values in block "), F.col("block").cast("string")))).otherwise(F.col("_low"))
    return g.select(by, (F.col("block") - 1).alias("block"), place, one.alias(value))


def file_kind(content: Column | str) -> Column:
    """xlsx, docx, pdf, ole or text by first bytes and members; null for an empty file or one that is cut short."""
    c = F.col(content) if isinstance(content, str) else content
    starts = lambda magic: F.substring(F.hex(F.substring(c, 1, 8)), 1, len(magic)) == magic
    member = lambda name: F.contains(c, F.lit(name.encode()))
    size = F.octet_length(c)
    return (
        F.when(size == 0, None)
        .when(starts(ZIP) & member("xl/workbook.xml"), "xlsx")
        .when(starts(ZIP) & member("word/document.xml"), "docx")
        .when(starts(PDF), F.when(size > 100, "pdf"))
        .when(starts(OLE), F.when(size > 512, "ole"))
        .when(~starts(ZIP) & F.is_valid_utf8(c), "text")
    )


def required_files(files: DataFrame, required: dict[str, int], name: str = "name", size: str = "length") -> DataFrame:
    """pattern, n_files, zero_bytes, status for each required pattern (a regular expression) and its least number of files."""
    hits = F.explode(F.filter(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(name).rlike(p).alias("hit")) for p in required]), lambda x: x["hit"])).alias("h")
    n = files.select(hits, size).groupBy("h.pattern").agg(F.count("*").alias("n_files"), F.count_if(F.col(size) == 0).alias("zero_bytes"))
    asked = files.sparkSession.createDataFrame(list(required.items()), "pattern string, least long")
    out = asked.join(n, "pattern", "left").fillna(0, ["n_files", "zero_bytes"])
    status = F.when(F.col("n_files") < F.col("least"), "BLOCK").when(F.col("zero_bytes") > 0, "BLOCK").otherwise("PASS")
    return out.select("pattern", "n_files", "zero_bytes", status.alias("status"))
