"""Document fingerprints from closed syncmers, in DataFrame functions only.

A document is a row of words. Every run of ``K`` words has K - S + 1 inner runs of ``S`` words; it is a *closed syncmer* if
the inner run with the smallest hash stands at its left or right edge. Whether a run is chosen depends on its own words
alone, never on what stands around it, so equal passages have equal anchors wherever they occur. The fingerprint is the
``SIZE`` smallest distinct anchor hashes in the order of their first places; two fingerprints are as alike as they have
anchors in common that follow each other in the same order. Where a passage lies in two texts is told by ``aligned`` over
all anchors and their positions.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, SIZE = 4, 2, 64  # the anchor test below is written for K - S + 1 = 3 inner runs
GROUP = 64  # rows that stand together when neighbours by id are looked up
KNOTS = 1000  # quantiles of the ids
LEFT_OVER = 4096  # rows at which one task may order what is left


def anchors(df: DataFrame, text: str = "text", out: str = "anchors") -> DataFrame:
    """``df`` with ``out``: array<struct<position int, hash bigint>> of the closed syncmers of the whole text.

    Words are runs without white space, in lower case. Texts of fewer than K words have one anchor, of all words; texts
    without a word, and nulls, have none. ``position`` counts words from 0, so anchors of two texts can be aligned.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), r"\s+"), lambda w: w != "")
    step = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    step = step.withColumn("_s", F.zip_with("_w", F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))
    inner, n = F.col("_s"), F.size("_w")

    def chosen(x: Column, i: Column) -> Column:
        middle, last = F.get(inner, i + 1), F.get(inner, i + 2)
        return F.when((middle >= F.least(x, last)), F.struct(i.cast("int").alias("position"), F.xxhash64(x, last).alias("hash")))

    runs = F.filter(F.transform(F.slice(inner, F.lit(1), n - (K - 1)), chosen), lambda a: a.isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64("_w").alias("hash")))
    found = F.when(n >= K, runs).when(n > 0, whole).otherwise(F.slice(whole, 1, 0))
    return step.withColumn(out, found).drop("_w", "_s")


def sketch(df: DataFrame, text: str = "text", out: str = "sketch") -> DataFrame:
    """``df`` with ``out``: array<bigint> of the SIZE smallest distinct anchors as unsigned 32-bit hashes, by their first places."""
    folded = F.transform("_a", lambda a: a["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))
    step = anchors(df, text, "_a").withColumn("_a", F.array_distinct(folded))
    return step.withColumn(out, F.array_intersect("_a", F.slice(F.sort_array("_a"), 1, SIZE))).drop("_a")


def as_hex(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the union's SIZE smallest hashes that both sketches have in one order, 0 to 1; two empty sketches are alike.

    Of the common anchors the longest row counts that rises in both texts: passages that swapped places, and anchors that
    meet by chance, are no likeness; words put in or left out between them are no harm.
    """
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    places = F.transform(F.array_intersect(F.array_intersect(a, b), union), lambda h: F.array_position(b, h))

    def place(ends: Column, x: Column) -> Column:  # the k-th is the smallest place at which a rising row of k anchors ends
        return F.concat(F.filter(ends, lambda e: e < x), F.array(x), F.slice(F.filter(ends, lambda e: e > x), 2, SIZE))

    rising = F.size(F.aggregate(places, F.array().cast("array<bigint>"), place))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(rising / F.size(union))


def aligned(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, offset, n_anchors: for each row of ``df`` (key unique, two columns of ``anchors``) by how many words the second text's
    most common passages lie behind the first's, and how many different anchors agree on that.

    All anchors count, whatever a text's length; of an anchor that repeats in a text the first place does. Anchors meet by
    equality. Ties go to the smallest offset; rows without a common anchor, and null keys, give none.
    """
    first = lambda c: df.select(key, F.explode(c).alias("x")).groupBy(key, F.col("x.hash").alias("hash")).agg(F.min("x.position").alias(c))
    met = first(a).join(first(b), [key, "hash"]).groupBy(key, (F.col(b) - F.col(a)).alias("offset")).agg(F.count("*").alias("n_anchors"))
    best = F.max_by(F.struct("offset", "n_anchors"), F.struct("n_anchors", -F.col("offset")))
    return met.groupBy(key).agg(best.alias("r")).select(key, "r.offset", "r.n_anchors")


def with_next(df: DataFrame, key: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """``df`` with ``columns`` of the row that follows in descending ``key``; after the last comes the first.

    Rows go to groups of about GROUP by a map of the key that rises evenly between KNOTS of its quantiles, so neither ids far
    off nor ids in clusters put many rows into one group, and no task orders the whole table; a key that is several quantiles,
    and null keys, which come last, are spread over groups by the hash of the first of ``columns``. A group's last row takes the first row
    of the next group with any, found the same way over one row a group. Rows with equal keys follow each other by that
    hash, then by the hash of all ``columns``, descending. A single row follows itself.
    """
    spread = df.agg(F.count("*").alias("rows"), F.count(key).alias("n"), F.percentile_approx(key, [k / KNOTS for k in range(KNOTS + 1)], 20_000).alias("q")).first()
    n, times = spread.n, Counter(spread.q or [0])
    knots = sorted(times)
    parts = [times[q] * n // KNOTS // GROUP if times[q] > 1 else 0 for q in knots]  # groups of a busy key of its own
    longs = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    place = F.size(F.filter(longs(knots), lambda q: q <= F.col(key).cast("long")))
    low, high = F.get(longs(knots), place - 1), F.get(longs(knots), place)
    share = F.when(high.isNotNull(), (F.col(key).cast("double") - low) / (high - low)).otherwise(0.0)
    per = max(1.0, n / GROUP / max(1, len(knots) - 1))
    even = F.floor((place - 1 + F.least(share, F.lit(0.999999))) * per)
    part = lambda count: F.floor(F.least((F.col("_hash") / 2.0**64 + 0.5) * count, count - 1))
    busy, through = F.get(longs(parts), place - 1), F.get(longs(accumulate(parts)), place - 1)
    own = even + through + F.when((F.col(key) == low) & (busy > 0), part(busy) - busy).otherwise(0) if any(parts) else even
    unknown = F.lit((spread.rows - n) // GROUP + 1)
    without = part(unknown) - unknown if spread.rows > n else F.lit(-1)  # where it isn't needed, groups are told by the key alone
    group = F.when(F.col(key).isNull(), without).when(place == 0, F.lit(0)).otherwise(own).cast("long")
    hashed = df.withColumn("_hash", F.xxhash64(columns[0]))
    rows = hashed.withColumn("_group", group)
    down = Window.partitionBy("_group").orderBy(F.col(key).desc_nulls_last(), F.col("_hash").desc(), F.xxhash64(*columns).desc())
    taken = F.struct(*columns)
    rows = rows.withColumn("_next", F.lead(taken).over(down)).withColumn("_place", F.row_number().over(down))
    heads = rows.where("_place = 1").select("_group", taken.alias("_head"))
    order = hashed.select(group.alias("_group")).distinct()
    above = _above(order).select("_group", "_above")
    heads = heads.join(above, "_group").select(F.col("_above").alias("_group"), "_head")
    out = rows.join(heads, "_group", "left").withColumn("_next", F.coalesce("_next", "_head"))
    return out.select(*df.columns, *[F.col("_next")[c].alias(prefix + c) for c in columns])


def _above(groups: DataFrame) -> DataFrame:
    """For each distinct ``_group`` the next larger one as ``_above``; for the largest, the smallest (the ring closes)."""
    size = groups.count()
    if size <= LEFT_OVER:
        up = Window.orderBy("_group")
        return groups.withColumn("_above", F.coalesce(F.lead("_group").over(up), F.first("_group").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    reach = groups.agg(F.min("_group").alias("low"), F.max("_group").alias("high")).first()
    width = max(2, -(-(reach.high - reach.low + 1) * GROUP // size))
    held = groups.withColumn("_block", F.floor((F.col("_group") - F.lit(reach.low)) / F.lit(width)).cast("long"))
    inside = held.withColumn("_above", F.lead("_group").over(Window.partitionBy("_block").orderBy("_group")))
    lows = held.groupBy("_block").agg(F.min("_group").alias("_low"))
    ring = _above(lows.select(F.col("_block").alias("_group"))).select(F.col("_group").alias("_block"), F.col("_above").alias("_next_block"))
    firsts = ring.join(lows.select(F.col("_block").alias("_next_block"), "_low"), "_next_block").select("_block", "_low")
    return inside.join(firsts, "_block").select("_group", F.coalesce("_above", "_low").alias("_above"))


def compare_with_edits(df: DataFrame) -> DataFrame:
    """Fingerprints of ``df`` (doc_id, text) and of each text whose second half is the next document's beginning.

    Columns: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as empty.
    """
    docs = sketch(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    both = with_next(docs, "doc_id", ["text", "sketch"]).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    edited = sketch(edited.select("doc_id", "n_chars", "sketch", "next_sketch", "edited"), "edited", "edited_sketch")
    return edited.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited",
        as_hex(F.col("sketch")).alias("fingerprint"),
        as_hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
