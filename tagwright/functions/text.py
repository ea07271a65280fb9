"""Text expressions: cleaning, comparison keys and deterministic ids. All are built-in columns, so they stay in code generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean a missing value.
NULL_TOKENS = ("", "nan", "none", "nat")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Trimmed text; null as empty."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def is_blank(c: Column | str) -> Column:
    return text(c) == ""


def non_blank(c: Column | str) -> Column:
    """The trimmed text, null where it is blank."""
    return F.nullif(text(c), F.lit(""))


def first_non_blank(*columns: Column | str) -> Column:
    """From left to right the first value that is not blank."""
    return F.coalesce(*map(non_blank, columns))


def normalize_asset(c: Column | str) -> Column:
    """Upper case with single blanks; missing-value texts become empty."""
    t = text(c)
    return F.when(F.lower(t).isin(*NULL_TOKENS), "").otherwise(F.trim(F.regexp_replace(F.upper(t), r"\s+", " ")))


def normalize_tag(c: Column | str) -> Column:
    """Letters and digits of a tag, without a leading site word (one that is followed by text with a digit)."""
    n = normalize_asset(c)
    tail = F.regexp_extract(n, r"^[^ ]+ (.*[0-9].*)$", 1)
    return F.regexp_replace(F.when(tail != "", tail).otherwise(n), "[^A-Z0-9]", "")


def match_key(c: Column | str) -> Column:
    """A key that ignores case and separators."""
    return F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]+", "")


def composite_key(*columns: Column | str) -> Column:
    return F.concat_ws("\x1f", *map(text, columns))


def entity_uid(prefix: str, *keys: Column | str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.sha1(F.concat_ws("|", *map(text, keys))))


def equipment_uid(plant: Column | str, asset: Column | str) -> Column:
    """Empty where the asset is blank."""
    a = normalize_asset(asset)
    return F.when(a == "", "").otherwise(F.concat(F.lit("eq:"), F.sha1(F.concat_ws("|", normalize_asset(plant), a))))


def measurement_name(c: Column | str) -> Column:
    """A name for a store's column: separators become underscores, everything else but letters and digits goes."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("None")), r"[.\s/-]", "_"), "[^A-Za-z0-9_]", "")


def basename(c: Column | str) -> Column:
    """What follows the last slash of either style."""
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"([^/\\]*)$", 1)


def floc_levels(c: Column | str) -> Column:
    """Levels of a functional location, most general first."""
    return F.filter(F.split(normalize_asset(c), r"[./\\]+"), lambda x: x != "")


def fold_vocabulary(c: Column | str, words: dict[str, str]) -> Column:
    """A controlled word for a text that matches one apart from case and separators; other texts stay."""
    folded = F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_")
    pairs = reduce(lambda out, kv: [*out, F.lit(kv[0]), F.lit(kv[1])], words.items(), [])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), folded), col(c))


def redact(c: Column | str) -> Column:
    """Values after words that announce a secret become ``***``."""
    return F.regexp_replace(col(c), r"(?i)\b(password|secret|token|api[_-]?key)(\s*[=:]\s*)\S+", "$1$2***")


def chunks(c: Column | str, size: int, overlap: int) -> Column:
    """The text in pieces of ``size`` characters, each beginning ``overlap`` characters before the last one's end."""
    t = F.coalesce(col(c), F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - overlap), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(t, s, F.lit(size)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: as a lambda's variable it is not written out, and done again, wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
