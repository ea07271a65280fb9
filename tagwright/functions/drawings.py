"""What a drawing's extracted text says: its number, components and connections, as column expressions over its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright.functions.pages import stripped
from tagwright.functions.text import col, let

# Section names, words of table headers, arrows, placeholders of a number, and the letters in a label that say what kind of component it is.
COMPONENTS, CONNECTIONS = "components", "connections"
HEADER_WORDS = ("tag", "type", "description", "bbox", "from", "to", "component", "bounding box")
ARROWS = (" → ", " -> ", "→", "->")
NO_NUMBER = ("[Drawing Number]", "N/A", "Unknown", "")
KINDS = (
    ("Vessel/Tank", ("MH", "HG", "SR", "DC", "BC", "DG", "VS")),
    ("Valve/Instrument", ("FV", "BF", "VF", "LQ", "RP", "HD")),
    ("Equipment", ("BE", "BW", "MS", "LD", "FG", "RF", "FN", "SH")),
)
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LABELLED = "array<struct<label:string,box_2d:string,point:string>>"


def lines_of(c: Column | str) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), BREAKS)


def drawing_number(c: Column | str) -> Column:
    """What stands below the heading of the number, else the first text that looks like one, else Unknown."""
    text = F.coalesce(col(c), F.lit(""))
    below = stripped(F.regexp_extract(text, "--- DRAWING NUMBER ---\\s*\n\\s*([^\n]+)", 1))
    like = F.regexp_extract(text, r"\b([A-Z0-9]{2,}-[A-Z0-9\-]{3,})\b", 1)
    return F.when(~below.isin(*NO_NUMBER), below).when(like != "", like).otherwise("Unknown")


def section(lines: Column, begin: str, end: str | None) -> Column:
    """The lines after the first that names the section, up to the first after it that names the next; marks and case don't count."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"[*|-]", ""))
    place = lambda xs, name: F.array_position(F.transform(xs, lambda x: F.contains(plain(x), F.lit(name))), F.lit(True)).cast("int")
    until = lambda rest: rest if end is None else let(place(rest, end), lambda stop: F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest))
    after = lambda xs, at: F.when(at > 0, let(F.slice(xs, at + 1, F.size(xs)), until)).otherwise(F.array().cast("array<string>"))
    return let(lines, lambda xs: let(place(xs, begin), lambda at: after(xs, at)))


def table_rows(lines: Column) -> Column:
    """Cells of the lines that are rows of a table; rules and headers are none, and empty cells don't count. Closing bars may be missing."""
    bars = F.filter(lines, lambda x: F.contains(x, F.lit("|")) & (F.regexp_replace(x, r"[-| ]", "") != ""))
    cells = F.transform(bars, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(stripped(c), F.lit("*"))), lambda c: c != ""))
    header = lambda r: F.exists(r, lambda c: F.lower(c).isin(*HEADER_WORDS))
    rule = lambda r: F.forall(r, lambda c: c.rlike(r"^-+\z"))
    return F.filter(cells, lambda r: (F.size(r) > 0) & ~header(r) & ~rule(r))


def _labelled(text: Column) -> Column:
    """Components of a JSON array of labelled boxes in the text; none where it can't be read."""
    items = F.from_json(F.regexp_extract(text, r"(?s)(\[\s*\{.*?\}\s*\])", 1), LABELLED)

    def component(x: Column) -> Column:
        return let(F.replace(stripped(x["label"]), F.lit("\n"), F.lit(" / ")), lambda label: named(x, label))

    def named(x: Column, label: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, codes in reversed(KINDS):
            kind = F.when(F.upper(label).rlike("|".join(codes)), name).otherwise(kind)
        box = F.regexp_replace(F.coalesce(x["box_2d"], x["point"], F.lit("")), r",\s*", ", ")
        return F.struct(label.alias("tag"), F.coalesce(kind, F.lit("Unknown")).alias("type"), F.lit("").alias("description"), box.alias("bbox"))

    found = F.transform(F.filter(items, lambda x: x["label"].isNotNull()), component)
    return F.coalesce(F.filter(found, lambda x: x["tag"] != ""), F.array().cast("array<struct<tag:string,type:string,description:string,bbox:string>>"))


def components(c: Column | str) -> Column:
    """array<struct<tag,type,description,bbox>> of the table of components, else of a JSON array of labelled boxes; null text gives none."""
    text = F.coalesce(col(c), F.lit(""))
    rows = table_rows(section(lines_of(text), COMPONENTS, CONNECTIONS))
    cell = lambda r, k: F.coalesce(F.get(r, F.lit(k)), F.lit(""))
    found = F.transform(rows, lambda r: F.struct(cell(r, 0).alias("tag"), cell(r, 1).alias("type"), cell(r, 2).alias("description"), cell(r, 3).alias("bbox")))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(_labelled(text)))


def connections(c: Column | str) -> Column:
    """array<struct<source,target>> of the table of connections, else of the lines with an arrow; null text gives none."""
    return let(lines_of(c), _connections)


def _connections(lines: Column) -> Column:
    pair = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    rows = F.transform(F.filter(table_rows(section(lines, CONNECTIONS, None)), lambda r: F.size(r) >= 2), lambda r: pair(F.get(r, F.lit(0)), F.get(r, F.lit(1))))

    def arrow(line: Column) -> Column:
        out = pair(F.lit(""), F.lit(""))
        for mark in reversed(ARROWS):
            at = F.instr(line, mark)
            a, b = F.substring(line, F.lit(1), at - 1), F.substring(line, at + len(mark), F.length(line))
            out = F.when(at > 0, pair(F.regexp_replace(stripped(a), "^[-• *]+", ""), F.regexp_replace(stripped(b), r"\.+\z", ""))).otherwise(out)
        return out

    arrows = F.filter(F.transform(F.transform(lines, stripped), arrow), lambda p: (p["source"] != "") & (p["target"] != ""))
    return let(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(arrows))
