"""Pages of a document packed into chunks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright.functions.text import col, let

AROUND = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
SPAN = "struct<first:int,last:int,whole:boolean>"


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), AROUND, "")


def pieces(t: Column, limit: int, overlap: int) -> Column:
    """A text in pieces of ``limit`` characters that begin every ``limit - overlap``; whole if it is no longer than one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)), F.lit(max(1, limit - overlap)))
    return F.when(F.length(t) <= limit, F.array(t)).otherwise(F.transform(starts, lambda s: F.substring(t, s, F.lit(limit))))


def packed(pages: Column | str, limit: int, overlap: int) -> Column:
    """Chunks (text, page_start, page_end) of an array of pages, in order.

    Pages, without blanks around them, fill a chunk up to ``limit`` characters, one for each line break included; a page that is longer
    goes in pieces of its own. Pages are counted from 1; a chunk ends at the page before the next one's, so blank pages behind it
    count to it. Null and blank pages make no chunk; null or no pages give none.

    The fold over pages carries numbers only: where chunks begin and end. Texts are put together once, from these.
    """
    return let(F.transform(F.coalesce(col(pages), F.array().cast("array<string>")), stripped), lambda p: _packed(p, limit, overlap))


def _packed(pages: Column, limit: int, overlap: int) -> Column:
    sizes = F.transform(pages, lambda p, k: F.struct((k + 1).alias("no"), F.length(p).alias("n")))
    span = lambda first, last, whole: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), whole.alias("whole"))
    state = lambda spans, first, n: F.struct(spans.alias("spans"), first.cast("int").alias("first"), n.cast("int").alias("n"))

    def closed(s: Column, last: Column) -> Column:
        """The spans with what is held, if anything is."""
        return F.when(s["n"] > 0, F.concat(s["spans"], F.array(span(s["first"], last, F.lit(True))))).otherwise(s["spans"])

    def step(s: Column, p: Column) -> Column:
        before = closed(s, p["no"] - 1)
        alone = state(F.concat(before, F.array(span(p["no"], p["no"], F.lit(False)))), p["no"] + 1, F.lit(0))
        full = (s["n"] > 0) & (s["n"] + p["n"] > limit)
        new = state(F.when(full, before).otherwise(s["spans"]), F.when(full | (s["n"] == 0), p["no"]).otherwise(s["first"]), F.when(full, 0).otherwise(s["n"]) + p["n"] + 1)
        return F.when(p["n"] == 0, s).when(p["n"] > limit, alone).otherwise(new)

    spans = F.aggregate(sizes, state(F.array().cast(f"array<{SPAN}>"), F.lit(1), F.lit(0)), step, lambda s: closed(s, F.size(pages)))

    def texts(s: Column) -> Column:
        own = F.array_join(F.filter(F.slice(pages, s["first"], s["last"] - s["first"] + 1), lambda p: p != ""), "\n")
        parts = F.when(s["whole"], F.array(own)).otherwise(let(own, lambda t: pieces(t, limit, overlap)))
        return F.transform(parts, lambda t: F.struct(t.alias("text"), s["first"].alias("page_start"), s["last"].alias("page_end")))

    return F.flatten(F.transform(spans, texts))


def pages_label(first: Column | str, last: Column | str) -> Column:
    """``3`` or ``3-5``; empty where there are no pages."""
    first, last = col(first), col(last)
    return F.when(first <= 0, "").when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))
