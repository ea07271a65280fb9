"""SimHash fingerprints and near-duplicate groups by a byte-position inverted index with count filtering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.llm.shared import connected_components, staged

BITS = 64
AT_ONCE = 1 << 16  # shingles whose bits are unpacked at a time


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of so many words, repeats included; fewer words make one run, none make none. ASCII case and white space only."""
    tokens = (text or "").encode().lower().split()
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return [line] if tokens else []
    starts = [0, *accumulate(len(t) + 1 for t in tokens)]
    return [line[a : b - 1] for a, b in zip(starts, starts[words:])]


def majority(digests: list[bytes], size: int) -> bytes:
    """Bit by bit what over half of the digests (of ``size`` bytes) have; without any, zero."""
    votes = np.zeros(8 * size, np.int64)
    for k in range(0, len(digests), AT_ONCE):
        part = np.frombuffer(b"".join(digests[k : k + AT_ONCE]), np.uint8).reshape(-1, size)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(digests), bitorder="little").tobytes()


def simhash(text: str | None, words: int) -> int:
    """64 bits by the shingles' XXH64 with seed 42."""
    digest = xxhash.xxh64_digest
    return int.from_bytes(majority([digest(s, 42) for s in shingles(text, words)], 8), "big")


def wide_simhash(text: str | None, words: int) -> bytes:
    """256 bits by two 128-bit hashes of each distinct shingle."""
    return wide_and_set(text, words)[0]


def wide_and_set(text: str | None, words: int) -> tuple[bytes, np.ndarray]:
    """The wide fingerprint, and the shingle set as ``shingle_set`` has it."""
    digest, distinct = xxhash.xxh3_128_digest, list(set(shingles(text, words)))
    firsts = [digest(s, 1) for s in distinct]
    hashes = np.unique(np.frombuffer(b"".join(firsts), "<i8")[::2])
    return majority([a + digest(s, 2) for a, s in zip(firsts, distinct)], 32), hashes


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh3_128_digest(s, 1) for s in set(shingles(text, words))]), "<i8")[::2])


def set_name(hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles: texts of one name have equal sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def fingerprints(df: DataFrame, words: int, text: str = "text", fingerprint: str = "fp") -> DataFrame:
    """``df`` with the SimHash of its whole text as a signed 64-bit ``fingerprint``; null and empty texts have zero."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([simhash(t.as_py(), words) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(fingerprint, of(F.col(f"`{text}`")))


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the positions at which two fingerprints have the same byte."""
    diff = a.bitwiseXOR(b)
    return sum((F.when(F.shiftrightunsigned(diff, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def near_pairs(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a < b) of the distinct ``fp`` of ``fps`` that differ in at most ``bits`` of 64 bits, each once.

    ``bits`` differing bits leave at least 8 - bits of the 8 positional bytes equal. The index posts a fingerprint once
    under every choice of so many positions, with the bytes there: a posting holds those that reach the minimum tally
    together, and a pair in several postings is taken from the first. Postings stay short: two distinct fingerprints in
    one agree in 8 - bits bytes. Spark takes the exploded index to be as small as the fingerprints and would send it to the
    driver for a broadcast: the hint keeps it among the executors.
    """
    if not 1 <= bits <= 3:
        raise ValueError("1 to 3 bits")
    least = 8 - bits
    skips = list(combinations(range(8), bits))
    masks = [sum(255 << 8 * p for p in range(8) if p not in skip) for skip in skips]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    posts = fps.select("fp", F.explode(F.array([F.struct(F.lit(k).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for k, m in enumerate(signed)])).alias("p")).select("p.choice", "p.bytes", "fp")
    a, b = posts.alias("a"), posts.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # the first choice that skips all differing positions
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(signed)])
    on = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.bytes") == F.col("b.bytes")) & (F.col("a.fp") < F.col("b.fp"))
    found = a.join(b.hint("merge"), on & (F.bit_count(diff) <= bits) & (first == F.col("a.choice")) & (shared_bytes(F.col("a.fp"), F.col("b.fp")) >= least))
    return found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def groups(df: DataFrame, words: int, bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row of ``df`` (doc_id, text).

    Exact copies meet as one fingerprint before any pair is formed. ``component_id`` is the smallest doc_id that a row
    reaches over links of at most ``bits`` bits; null if all of these are null. Texts without a word have fingerprint zero
    and link like any other. Repeated rows stay repeated; an empty table gives no rows.
    """
    rows = staged(fingerprints(df.select("doc_id", "text"), words).select("doc_id", "fp"), "fp")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = connected_components(near_pairs(distinct, bits).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    members = linked.join(distinct, linked.node == distinct.fp).select("fp", "component", "least")
    least = members.groupBy("component").agg(F.min("least").alias("of_component"))
    named = members.join(least, "component").select(F.col("fp").alias("linked_fp"), "of_component")
    classes = distinct.join(named, F.col("fp") == F.col("linked_fp"), "left").select("fp", F.coalesce("of_component", "least").alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


WIDE_BYTES = 32
LEAST = 2  # shared positional bytes of a pair; 99.3 % of pairs at exactly 0.8 have as many, about 7 on average (simulated)
PARTS = ("f0", "f1", "f2", "f3")
BLOCK = 1024  # names of a posting that one task compares with the rest of it
FEW = 8  # names of a posting whose pairs are fewer than four times its rows: these are formed as they are
MIX = np.uint64(0x9E3779B97F4A7C15)
ANCHORS = np.random.default_rng(5).integers(1, 1 << 63, WIDE_BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # a hash function for each position


def most_bits(similarity: float) -> int:
    """Differing bits of 256 that pairs of that Jaccard index stay within.

    Such sets have a cosine of 2 s / (1 + s) at least; a SimHash bit then differs with chance angle / pi. The limit lies four
    standard deviations above the mean, where some 1 in 10 000 pairs are lost.
    """
    bits = 8 * WIDE_BYTES
    flip = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * flip + 4 * math.sqrt(bits * flip * (1 - flip)))


def posting_keys(fingerprint: bytes, hashes: np.ndarray) -> np.ndarray:
    """The fingerprint's posting at each of its byte positions, of a text with these shingles; none without a shingle.

    A position's byte alone would be shared by a 256th of all texts. So its postings are told apart by an *anchor* as well:
    the shingle that is the smallest by the position's own hash, which two texts share with a chance of their Jaccard index.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    least, x = np.full(WIDE_BYTES, np.iinfo(np.uint64).max, np.uint64), hashes.view(np.uint64)
    for k in range(0, len(x), AT_ONCE // WIDE_BYTES):
        least = np.minimum(least, (x[k : k + AT_ONCE // WIDE_BYTES, None] * ANCHORS).min(axis=0))
    place = np.arange(WIDE_BYTES, dtype=np.uint64) << np.uint64(8) | np.frombuffer(fingerprint, np.uint8)
    mixed = (least ^ (place + np.uint64(1)) * MIX) * MIX
    return (mixed ^ mixed >> np.uint64(29)).view(np.int64)


def hamming(pairs: DataFrame, distinct: DataFrame, most: int) -> DataFrame:
    """Those of ``pairs`` (a, b: names) whose fingerprints in ``distinct`` (name, *PARTS) differ in at most so many bits."""
    named = lambda x: distinct.select(F.col("name").alias(x), *[F.col(f).alias(f"{x}_{f}") for f in PARTS])
    differ = sum((F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in PARTS), F.lit(0))
    return pairs.join(named("a"), "a").join(named("b"), "b").where(differ <= most).select("a", "b")


def open_postings(posts: DataFrame, of_component: DataFrame) -> DataFrame:
    """key, name, component, size of the postings (key, name) that hold several components: those of one have no pair left to find."""
    rows = posts.join(of_component, F.col("name") == F.col("node"), "left").select("key", "name", F.coalesce("component", "name").alias("component"))
    several = rows.groupBy("key").agg(F.min("component").alias("_l"), F.max("component").alias("_h"), F.count("*").alias("size")).where("_l <> _h").select("key", "size")
    return rows.join(several, "key")


def rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """name, n, rare of ``sets`` (name, hashes): the set's size, and its rarest hashes, as many as a set that alike may lack and one more.

    All sets are in one order, by how many of them have a hash and by the hash. Two sets of n and m hashes that have c in
    common both have one of these among their first n - c + 1 and m - c + 1.
    """
    each = sets.select("name", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    common = each.groupBy("hash").agg(F.count("*").alias("held")).where("held > 1")
    ranked = each.join(common, "hash", "left").groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "hash"))).alias("_all"))
    kept = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-6) + 1).cast("int")
    return ranked.select("name", "n", F.transform(F.slice("_all", F.lit(1), kept), lambda x: x["hash"]).alias("rare"))


def tallied_pairs(posts: DataFrame, of_component: DataFrame, distinct: DataFrame, most: int, least: int = LEAST) -> DataFrame:
    """Pairs (a < b) of names in different components, within ``most`` differing bits, that meet in at least ``least`` postings
    of ``posts`` (key, name); ``distinct`` has the fingerprints (name, *PARTS)."""
    return meeting_pairs(open_postings(posts, of_component), distinct, most, least)


def meeting_pairs(rows: DataFrame, distinct: DataFrame, most: int, least: int = LEAST, rare: DataFrame | None = None, similarity: float = 0.8) -> DataFrame:
    """The pairs of ``tallied_pairs`` in ``rows`` (see ``open_postings``), as far as they may be alike.

    ``rare`` (see ``rarest``) may know some of the names: pairs of these meet only if their sets can be alike by
    ``similarity``. In a large group of copies whose differences are their own hardly any can, so that the pairs do not grow
    with its square. A posting of n names is dealt over n / BLOCK blocks: the left rows are split among these, the right rows
    go to all, so no task holds the n * n / 2 meetings of one posting; of a pair no more than its count leaves a task.
    """
    rows = rows.join(distinct.select("name", *PARTS), "name").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    rows = rows.join(rare, "name", "left") if rare is not None else rows.withColumns({"n": F.lit(None).cast("int"), "rare": F.lit(None).cast("array<long>")})
    side = lambda df, x: df.select("key", "block", *[F.col(c).alias(f"{x}_{c}") for c in ("name", "component", *PARTS, "n", "rare")])
    differ = sum((F.bit_count(F.col(f"a_{f}").bitwiseXOR(F.col(f"b_{f}"))) for f in PARTS), F.lit(0))
    left = side(rows.withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks"))), "a")
    right = side(rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))), "b").withColumnsRenamed({"key": "b_key", "block": "b_block"})
    on = (F.col("key") == F.col("b_key")) & (F.col("block") == F.col("b_block")) & (F.col("a_name") < F.col("b_name")) & (F.col("a_component") != F.col("b_component"))
    in_common = F.ceil(similarity / (1 + similarity) * (F.col("a_n") + F.col("b_n")) - 1e-6)
    firsts = lambda x: F.slice(f"{x}_rare", F.lit(1), F.greatest(F.col(f"{x}_n") - in_common + 1, F.lit(0)).cast("int"))
    may = F.col("a_rare").isNull() | F.col("b_rare").isNull() | F.arrays_overlap(firsts("a"), firsts("b"))
    met = left.join(right, on & (differ <= most) & may).groupBy(F.col("a_name").alias("a"), F.col("b_name").alias("b")).agg(F.count("*").alias("n"))
    return met.where(F.col("n") >= least).select("a", "b")


def name_filter(names: DataFrame, bits: int) -> np.ndarray:
    """A bit for each number modulo 2 ** bits that some of ``names`` (name) leaves: 2 ** (bits - 3) bytes, at most 16 MB."""
    value = F.pmod("name", F.lit(1 << bits)) + 1
    rows = names.groupBy(F.bitmap_bucket_number(value).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")).collect()
    out = np.zeros(max(1, (1 << bits) >> 15) * 4096, np.uint8)
    for r in rows:
        out[4096 * (r.k - 1) : 4096 * r.k] = np.frombuffer(r.bits, np.uint8)
    return out


def sets_of(needed: DataFrame, df: DataFrame, words: int) -> DataFrame | None:
    """name, hashes: the shingle sets of the texts in ``df`` (doc_id, text) that ``needed`` (name) names; None if it names none.

    A bit filter of bounded size, which lets all needed names and few others pass, keeps other texts' sets from moving.
    """
    needed = staged(needed.select("name").distinct(), "needed")
    n = needed.count()
    if not n:
        return None
    bits = min(27, max(15, (32 * n).bit_length()))
    wanted = df.sparkSession.sparkContext.broadcast(name_filter(needed, bits))

    def sets_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                named = [(set_name(x), x) for x in (shingle_set(t.as_py(), words) for t in batch.column(0).slice(k, 500))]
                named = [(m, x) for m, x in named if wanted.value[(m & (1 << bits) - 1) >> 3] >> (m & 7) & 1]
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in named], pa.int64()), pa.array([x for _, x in named], pa.list_(pa.int64()))], ["name", "hashes"])

    sets = df.select("text").mapInArrow(sets_in, "name long, hashes array<long>").join(needed, "name", "left_semi")
    return staged(sets.groupBy("name").agg(F.any_value("hashes").alias("hashes")), "sets")


def alike(pairs: DataFrame, df: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: names) whose texts in ``df`` (doc_id, text) have shingle sets of at least that Jaccard index."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("name")), df, words)
    if sets is None:
        return pairs
    named = lambda x: sets.select(F.col("name").alias(x), F.col("hashes").alias(f"{x}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    found = pairs.join(named("a"), "a").join(named("b"), "b").withColumn("both", both)
    return found.where(F.col("both") + 1e-9 >= similarity * (F.size("a_set") + F.size("b_set") - F.col("both"))).select("a", "b")


def near_duplicate_classes(df: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id of every row of ``df`` (doc_id, text), see ``classes_of_texts``."""
    return classes_of_texts(df, words, similarity).select("doc_id", "class_id")


def classes_of_texts(df: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key, class_id, class_key of every row of ``df`` (doc_id, text): classes of texts whose shingle sets are about that alike.

    A text has a SimHash of 256 bits, and the inverted index posts each distinct text under its byte at every position
    (``posting_keys``). Links are gathered in two steps, so that a large class costs no square of its size: first each text
    meets the one with the most meetings in its postings (a group of copies is a star around what they were copied from, whose
    rays are not alike themselves); then all pairs that these links have not yet put into one
    component, and that share at least LEAST positional bytes; no other pair can change a class. Pairs of both steps become
    links if they are within ``most_bits`` and the Jaccard index of their shingle sets is at least ``similarity``.
    ``class_id`` is the smallest doc_id of a class, null if all ids in it are null; of rows of that id ``class_key`` is the least
    ``text_key``, a hash of the text, so that an id which stands for several texts names one of them. Texts without a word are
    one class. An empty table gives no rows.
    """

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [wide_and_set(t.as_py(), words) for t in part.column(1)]
                fp = np.frombuffer(b"".join([f for f, _ in found]), "<i8").reshape(-1, 4)
                keys = pa.array([posting_keys(f, x) for f, x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([set_name(x) for _, x in found], pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in fp.T), keys], ["doc_id", "text_key", "name", *PARTS, "keys"])

    columns = f"doc_id long, text_key long, name long, {', '.join(f'{f} long' for f in PARTS)}, keys array<long>"
    rows = staged(df.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(wide, columns), "wide")
    # texts of equal shingle sets are one from here on
    first_row = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key")))
    distinct = staged(rows.groupBy("name").agg(first_row.alias("least"), F.any_value(F.struct(*PARTS, "keys")).alias("w")).select("name", "least", "w.*"), "distinct")
    posts = distinct.select("name", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posts = staged(posts.join(shared.hint("merge"), "key").select("key", "name", "n"), "postings")  # sized as before the explode, see near_pairs
    # a text that others were made from meets more texts than these meet each other: the one with the most meetings stands for a posting
    meetings = posts.groupBy("name").agg(F.sum("n").alias("meetings"))
    hubs = posts.join(meetings, "name").groupBy("key").agg(F.max(F.struct("meetings", "name")).alias("hub")).select("key", F.col("hub.name").alias("hub"))
    most = most_bits(similarity)
    met = posts.join(hubs, "key").where("name <> hub").select(F.least("hub", "name").alias("a"), F.greatest("hub", "name").alias("b")).distinct()
    first = staged(hamming(met, distinct, most), "pairs")
    linked_first = staged(alike(first, df, words, similarity), "links")
    so_far = connected_components(linked_first.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    still = staged(open_postings(posts, so_far), "open")
    in_many = sets_of(still.where(F.col("size") > FEW), df, words)
    rare = None if in_many is None else staged(rarest(in_many, similarity), "rare")
    second = staged(meeting_pairs(still, distinct, most, LEAST, rare, similarity).join(first, ["a", "b"], "left_anti"), "pairs")
    linked_second = staged(alike(second, df, words, similarity), "links")
    linked = connected_components(linked_first.union(linked_second).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    members = linked.join(distinct, linked.node == distinct.name).select("name", "component", "least")
    named_by = members.groupBy("component").agg(F.min("least").alias("of_component"))
    moved = members.join(named_by, "component").select(F.col("name").alias("linked"), "of_component")
    classes = distinct.join(moved, F.col("name") == F.col("linked"), "left").select("name", F.coalesce("of_component", "least").alias("_first"))
    return rows.select("doc_id", "text_key", "name").join(classes, "name").select("doc_id", "text_key", F.col("_first.doc_id").alias("class_id"), F.col("_first.text_key").alias("class_key"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class only, that of the smallest doc_id (of several texts under it the one with the least hash).

    A row that repeats id and text stays once, other texts under a repeated id stay if their class has no smaller id; rows
    without an id stay.
    """
    classes = classes_of_texts(docs, words, similarity)
    gone = classes.where("doc_id <> class_id or text_key <> class_key").select("doc_id", F.col("text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    kept = keyed.where("doc_id is not null").join(gone, ["doc_id", "_key"], "left_anti").dropDuplicates(["doc_id", "_key"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))
