"""What plant tags and functional locations are made of: column expressions that stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright.functions.text import col, floc_levels, normalize_asset, text

# How tags are written in free text, words that only look like tags, codes of measurements and sub-equipment.
TAG_SHAPES = (
    r"\b\d{2,4}-[A-Z]{1,4}-\d{3,5}-\d{3,5}(?:-[A-Z0-9]+)?\b",
    r"\b[A-Z]{1,4}-\d{1,5}[A-Z]?\b",
    r"\b[A-Z]{1,4}\d{2,5}[A-Z]?\b",
    r"\b[A-Z]{2,4}\s\d{1,4}[A-Z]?\b",
)
NO_TAGS = "PSC HC CUI NDT SKA EOR MALT LOPC AIF PPE AT ON IN IT IS AS TO BY OF NO OR AN A AND THE WAS FOR ALL HRS HOUR HOURS AM PM JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC TIER CAT REV REF".split()
MEASUREMENTS = {"IZ": ("current", "Amps"), "JZ": ("power", "kW"), "SZ": ("speed", "RPM"), "TZ": ("temperature", "°C"), "PZ": ("pressure", "mmWC"), "LZ": ("level", "%"), "FZ": ("flow", "TPH"), "ZZ": ("position", "%"), "BW": ("weight", "Tonnes")}
SUB_EQUIPMENT = {
    "-B1": "Burner",
    "-D1": "Drag Chain Conveyor",
    "-F1": "Fan/Blower",
    "-F2": "Fan/Blower",
    "-G1": "Gearbox",
    "-H1": "Hydraulic Unit",
    "-M1": "Motor",
    "-M2": "Motor",
    "-R1": "Refractory",
    "-S1": "Separator",
    "-T1": "Tyre/Roller Support",
    "-T2": "Tyre/Roller Support",
    "-T3": "Tyre/Roller Support",
}
UPPER_WORDS = ("HP", "LP", "NG", "LPG", "GAS", "WO", "ID", "OD", "RPM", "OK")
PID_SHAPE = r"\d{3}[A-Z]{2}\d+(?:-\d+)?"
TOKEN_SHAPE = r"\b(?=[A-Za-z0-9_-]*[A-Za-z])(?=[A-Za-z0-9_-]*\d)[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*\b"


def mapped(key: Column, words: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), key)


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Z0-9]", "")


def distinct_in_order(values: Column, key=lambda x: x) -> Column:
    """The first of all values with an equal key; empty keys go."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: (key(x) != "") & (F.array_position(keys, key(x)) == i + 1))


def numeric_parts(c: Column | str) -> Column:
    """A tag's numbers as texts without leading zeros, in order."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(r"[0-9]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", ""))


def sibling_suffix(c: Column | str) -> Column:
    """What follows a tag's last digit, in upper case; empty without a digit."""
    t = F.upper(text(c))
    return F.when(t.rlike("[0-9]"), F.regexp_replace(t, "^.*[0-9]", "")).otherwise("")


def floc(c: Column | str) -> Column:
    """struct(site, levels, parent, item) of a functional location; null without a level."""
    levels = floc_levels(c)
    leaf, top = F.get(levels, F.size(levels) - 1), F.get(levels, F.lit(0))
    after = F.regexp_extract(leaf, "^[^-]*-(.*)$", 1)
    before = F.when(after != "", F.substring_index(leaf, "-", 1)).otherwise("")
    parts = F.struct(F.substring_index(top, "-", 1).alias("site"), levels.alias("levels"), alnum(before).alias("parent"), alnum(F.when(after != "", after).otherwise(leaf)).alias("item"))
    return F.when(F.size(levels) > 0, parts)


def physical_tag(c: Column | str) -> Column:
    """The tag that a location names: ``B32-K1`` is ``B32-K-0001``, a location of several levels its item; others stay."""
    raw, place = F.coalesce(col(c).cast("string"), F.lit("")), floc(c)
    last = F.substring_index(raw, "-", -1)
    letters, digits, rest = (F.regexp_extract(last, "^([A-Za-z]+)([0-9]+)([A-Za-z]?)$", k) for k in (1, 2, 3))
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    flat = F.when(raw.contains("-") & (letters != ""), F.concat(F.substring_index(raw, "-", 1), F.lit("-"), F.upper(letters), F.lit("-"), padded, F.upper(rest))).otherwise(raw)
    return F.when(F.size(place["levels"]) > 1, F.coalesce(F.nullif(place["item"], F.lit("")), raw)).otherwise(flat)


def pid_candidates(direct: list[str], texts: list[str]) -> Column:
    """Tags to try: the ``direct`` columns' letters, digits and hyphens, then what looks like a diagram tag in ``texts``."""
    clean = lambda x: F.regexp_replace(F.upper(x), r"[^A-Z0-9\-]+", "")
    own = F.array(*[F.when(F.lower(text(c)) == "nan", "").otherwise(clean(text(c))) for c in direct])
    found = F.flatten(F.array(*[F.regexp_extract_all(F.upper(text(c)), F.lit(PID_SHAPE), F.lit(0)) for c in texts]))
    return distinct_in_order(F.concat(own, found))


def description_candidates(c: Column | str) -> Column:
    """Words with letters and digits, the first of those that differ in case and separators only."""
    return distinct_in_order(F.regexp_extract_all(text(c), F.lit(TOKEN_SHAPE), F.lit(0)), lambda x: alnum(F.upper(x)))


def floc_candidates(c: Column | str) -> Column:
    """Tags in a location's last level: its last part, its first, all but the first; the level itself where there is none."""
    leaf = F.substring_index(text(c), ".", -1)
    parts = F.split(leaf, "-")
    several = F.size(parts) > 1
    last = F.when(several, F.regexp_extract(F.element_at(parts, -1), "^[A-Za-z0-9]+", 0)).otherwise("")
    first = F.regexp_extract(F.get(parts, F.lit(0)), "^[A-Za-z0-9]+", 0)
    rest = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), "-")).otherwise("")
    found = distinct_in_order(F.transform(F.array(last, first, rest), F.upper))
    bare = F.replace(F.upper(leaf), F.lit("-"), F.lit(""))
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.array(bare), lambda x: x != ""))


def clean_description(c: Column | str) -> Column:
    """For people: no leading number or tag, single blanks, and no shouting but for some words."""
    t = text(c)
    t = F.regexp_replace(F.regexp_replace(t, r"^[0-9]+\s+", ""), r"^[A-Z]{1,3}[0-9]+[A-Z]?\s+", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    calm = F.array_join(F.transform(F.split(t, " "), lambda w: F.when(F.upper(w).isin(*UPPER_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))), " ")
    return F.when(F.lower(text(c)).isin("", "nan", "none"), "").when(t == F.upper(t), calm).otherwise(t)


def hierarchy(c: Column | str, separator: str = "\\") -> Column:
    """A path's segments without blank ones."""
    return F.filter(F.transform(F.split(text(c), F.lit(rf"\Q{separator}\E")), lambda x: F.trim(x)), lambda x: x != "")


def at_depth(segments: Column, depth: int) -> Column:
    """The last segment of a path of at least so many."""
    return F.when(F.size(segments) >= depth, F.get(segments, F.size(segments) - 1))


def deepest_level(segments: Column, levels: dict[str, int], preference: list[str], confidence: dict[str, float]) -> Column:
    """struct(level, confidence): the first preferred level (name -> place in the path) that the path has."""
    at = [F.when(F.get(segments, F.lit(levels[name])).isNotNull(), F.struct(F.lit(name).alias("level"), F.lit(float(confidence.get(name, 0.0))).alias("confidence"))) for name in preference]
    return F.coalesce(*at, F.struct(F.lit("").alias("level"), F.lit(0.0).alias("confidence")))


def point_reference(c: Column | str, separator: str = ".") -> Column:
    """struct(tag, attribute) of a point: the last two parts; one part is the tag. Null where blank."""
    parts = F.split(text(c), F.lit(rf"\Q{separator}\E"))
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    several = F.size(parts) > 1
    tag = F.when(several, blank(F.get(parts, F.size(parts) - 2))).otherwise(F.nullif(text(c), F.lit("")))
    return F.struct(tag.alias("tag"), F.when(several, blank(F.element_at(parts, -1))).alias("attribute"))


def sub_equipment(suffix: Column | str) -> Column:
    return F.coalesce(mapped(col(suffix), SUB_EQUIPMENT), F.lit("Sub-component"))


def area_code(c: Column | str, length: int = 3) -> Column:
    return F.substring(F.regexp_extract(text(c), "^[0-9]+", 0), 1, length)


def without_suffixes(c: Column | str, suffixes: list[str]) -> Column:
    """A tag without words that a vendor put behind it."""
    t = text(c)
    for s in suffixes:
        t = F.trim(F.regexp_replace(t, rf"(?i)\s+\Q{s}\E(\s+|$)", " "))
    return t


def measurement_code(c: Column | str) -> Column:
    """The first two letters in a row behind a tag's first underscore, else in the tag."""
    t = F.upper(text(c))
    right = F.when(t.contains("_"), F.regexp_extract(t, "^[^_]*_(.*)$", 1)).otherwise(t)
    return F.regexp_extract(right, "[A-Z]{2}", 0)


def measurement(c: Column | str) -> Column:
    """struct(name, uom) of a tag's measurement code; nulls where it is no known one."""
    code = measurement_code(c)
    return F.struct(mapped(code, {k: v[0] for k, v in MEASUREMENTS.items()}).alias("name"), mapped(code, {k: v[1] for k, v in MEASUREMENTS.items()}).alias("uom"))


def asset_part(c: Column | str, duplicate: str = "", paths: tuple[str, ...] = (), attributes: tuple[str, ...] = ()) -> Column:
    """A historian tag without the mark of a duplicate, the path before it and the attribute behind it."""
    t = text(c)
    t = F.when(F.lower(t).isin("nan", "none", "nat", "null", "<na>", "n/a", "na"), "").otherwise(t)
    if duplicate:
        t = F.substring_index(t, duplicate, 1)
    for s in paths:
        t = F.substring_index(t, s, -1)
    for s in attributes:
        t = F.substring_index(t, s, 1)
    return F.trim(t)


def asset_key(c: Column | str, aggregates: tuple[str, ...] = (), instruments: tuple[str, ...] = (), least: int = 3, **parts) -> Column:
    """What to look an asset up by: the first run of digits and letters of the tag's first word, without the suffixes of
    aggregates and instruments; else the whole tag's letters and digits if there are ``least``, else its first word."""
    part = F.upper(asset_part(c, **parts))
    one_of = lambda words, tail: "(?:" + "|".join(rf"\Q{w.upper()}\E{tail}" for w in words) + ")$"
    first = alnum(F.regexp_extract(part, r"^[^_\s\-]*", 0))
    first = F.regexp_replace(first, one_of(aggregates, ""), "") if aggregates else first
    first = F.regexp_replace(first, one_of(instruments, "[0-9]*"), "") if instruments else first
    found, whole = F.regexp_extract(first, "[0-9]+[A-Z]+[A-Z0-9]*|[A-Z]+[0-9]+[A-Z0-9]*", 0), alnum(part)
    return F.when(found != "", found).when(F.length(whole) >= least, whole).otherwise(F.regexp_extract(part, "[A-Z0-9]+", 0))


def cleaned(c: Column | str) -> Column:
    """Upper case, single blanks, missing-value texts empty, ``123.0`` as ``123``."""
    t = text(c)
    t = F.when(F.lower(t).isin("nan", "none", "nat", "null"), "").when(t.rlike(r"^[0-9]+\.0+$"), F.substring_index(t, ".", 1)).otherwise(t)
    return normalize_asset(t)


def from_floc(c: Column | str) -> Column:
    """struct(asset, method) of a location: the end of its last level behind a hyphen (``floc_tail``), else the level
    (``floc_segment``), with the whole location where that is but a system's code; null where blank."""
    t = cleaned(c)
    tail = F.trim(F.substring_index(t, ".", -1))
    end = F.trim(F.substring_index(tail, "-", -1))
    code = "^[A-Z]{2,4}$"
    good = tail.contains("-") & (F.length(end) >= 2) & ~end.rlike("^[0-9]+$") & ~end.rlike(code)
    found = lambda x, how: F.struct(x.alias("asset"), F.lit(how).alias("method"))
    return F.when(tail == "", None).when(good, found(end, "floc_tail")).when(tail.rlike(code) & t.contains("."), found(t, "floc_segment")).otherwise(found(tail, "floc_segment"))


def from_text(c: Column | str) -> Column:
    """The first tag-shaped word of a text, by shape and then by place, behind a colon near its start; null where none."""
    t = cleaned(c)
    body = F.when(F.substring(t, 1, 12).contains(":"), F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1)).otherwise(t)
    words = F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(shape), F.lit(0)) for shape in TAG_SHAPES]))
    words = F.transform(words, lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("-")))
    return F.get(F.filter(words, lambda x: ~F.substring_index(x, "-", 1).isin(*NO_TAGS)), F.lit(0))
