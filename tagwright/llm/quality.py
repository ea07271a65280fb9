"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model, trained on trusted text.

An n-gram is ``ORDER`` UTF-16 units of text, so every script counts letter by letter and nothing is merged or left out;
the count tables have a row for each n-gram that occurs and grow with the corpus. Discounts, continuation counts and
interpolation weights come from joins of count tables that are hash-partitioned (sharded) by n-gram and by context.

Documents are scored by joins as well. Each task puts its documents into *batches* of about ``BATCH_BYTES`` and asks once
for each distinct n-gram of a batch; the distinct n-grams of all batches meet the count tables level by level, each
leaving with its cost; the costs go back to the batches that asked and are added up document by document. So a common
n-gram is asked for once a batch, not once an occurrence, and no table is collected or broadcast.

A document is kept if its perplexity is at most a quantile of the trusted documents' in its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.shared import staged, within

ORDER, BITS = 4, 16  # four 16-bit units fit a long
QUANTILE = 0.99
PRIOR = 30  # as many trusted documents of all languages count in each language's threshold
AT_ONCE = 1 << 20  # n-grams sorted at a time
BATCH_BYTES = 24 << 20  # of text
MOST_TRUSTED = 4_000_000  # ids (32 MB) up to which the trusted ids are broadcast; beyond it documents are shuffled to them
NO_UNIT = 0xFFFF  # no character; stands for U+0000, whose number marks the edges


def grams(text: str | None) -> np.ndarray:
    """The n-grams of the whole text with edges before and after it, as unsigned 64-bit numbers."""
    units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    units[units == 0] = NO_UNIT
    x = np.concatenate([np.zeros(ORDER - 1, np.uint64), units, np.zeros(1, np.uint64)])
    out = np.zeros(len(x) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(BITS) | x[k : k + len(out)]
    return out


class Tally:
    """Distinct n-grams and how often each was added, sorted AT_ONCE at a time."""

    def __init__(self):
        self.seen, self.times, self.held, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, text: str | None) -> None:
        g = grams(text)
        for k in range(0, len(g), AT_ONCE):
            self.held.append(g[k : k + AT_ONCE])
            self.size += len(self.held[-1])
            if self.size > AT_ONCE:
                self.merge()

    def merge(self) -> None:
        if self.held:
            g, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.seen, place = np.unique(np.concatenate([self.seen, g]), return_inverse=True)
            self.times = np.bincount(place, np.concatenate([self.times, n]), len(self.seen)).astype(np.int64)
            self.held, self.size = [], 0


def ngram_counts(texts: DataFrame) -> DataFrame:
    """gram long, n long: over the whole of all ``texts`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for text in batch.column(0):
                tally.add(text.as_py())
        tally.merge()
        yield pa.RecordBatch.from_arrays([pa.array(tally.seen.view(np.int64)), pa.array(tally.times)], ["gram", "n"])

    return texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def last(gram: Column, units: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << BITS * units) - 1)) if units < ORDER else gram


def context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, BITS)


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney's three discounts from the numbers of n-grams seen once to four times."""
    t = {r.n: r.c for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
    t1, t2 = t.get(1, 0), t.get(2, 0)
    if not t1 or not t2:
        return [0.5, 0.75, 0.9]
    y = t1 / (t1 + 2 * t2)
    return [min(k - 0.05, max(0.05, k - (k + 1) * y * t.get(k + 1, 0) / t[k])) if t.get(k) else k / 2 for k in (1, 2, 3)]


class Model:
    """``p``: by order, gram and its probability after its context; ``weight``: by order, context and what it leaves to the next lower order."""

    def __init__(self, p: dict[int, DataFrame], weight: dict[int, DataFrame], unseen: float):
        self.p, self.weight, self.unseen = p, weight, unseen


def fit(trusted: DataFrame) -> Model:
    """The model of all ``trusted`` texts (text), its tables written to the shared folder. Without any text all n-grams cost alike."""
    counts = {ORDER: staged(ngram_counts(trusted), "ngrams")}
    for order in range(ORDER - 1, 0, -1):  # how many different units stand before an n-gram
        counts[order] = staged(counts[order + 1].groupBy(last(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n")), "ngrams")
    p, weight = {}, {}
    units = counts[1].count()
    lower = 1 / (units + 1)  # any unit that was never seen is one more
    for order in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[order])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        held = counts[order].select("gram", "n", cut.alias("cut"), context(F.col("gram")).alias("context"))
        weight[order] = staged(held.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight")), "weights")
        shares = held.join(weight[order], "context")
        alone = (F.col("n") - F.col("cut")) / F.col("total")
        if order == 1:
            p[1] = staged(shares.select("gram", (alone + F.col("weight") * lower).alias("p")), "probabilities")
        else:
            below = p[order - 1].select(F.col("gram").alias("shorter"), F.col("p").alias("p_below"))
            joined = shares.join(below, last(F.col("gram"), order - 1) == F.col("shorter"))
            p[order] = staged(joined.select("gram", (alone + F.col("weight") * F.col("p_below")).alias("p")), "probabilities")
    one = weight[1].first()  # a single row: order 1 has one context
    return Model(p, weight, lower * one["weight"] if one else 1.0)


def costs(wanted: DataFrame, model: Model) -> DataFrame:
    """gram, cost (-log P) of the distinct ``wanted`` (gram): an n-gram that was not seen falls back on its shorter ones."""
    found = []
    open_ = wanted.select("gram", F.lit(1.0).alias("share"))
    for order in range(ORDER, 0, -1):
        own = last(F.col("gram"), order)
        p = model.p[order].select(F.col("gram").alias("known"), "p")
        met = open_.join(p, own == F.col("known"), "left").select("gram", "share", "p")
        if order == 1:
            found.append(met.select("gram", (-F.log(F.col("share") * F.coalesce("p", F.lit(model.unseen)))).alias("cost")))
            break
        met = staged(met, "met")
        found.append(met.where("p is not null").select("gram", (-F.log(F.col("share") * F.col("p"))).alias("cost")))
        weight = model.weight[order].select("context", "weight")
        rest = met.where("p is null").select("gram", "share", context(own).alias("context")).join(weight, "context", "left")
        open_ = rest.select("gram", (F.col("share") * F.coalesce("weight", F.lit(1.0))).alias("share"))
    return reduce(DataFrame.union, found)


def in_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """A task's rows in runs of about BATCH_BYTES of text, each with a number of its own; ``text`` is the place of that column."""
    part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        ends, at, before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)), 0, 0
        while at < batch.num_rows:
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + BATCH_BYTES - size)) + 1)
            held.append(batch.slice(at, stop - at))
            size, at, before = size + ends[stop - 1] - before, stop, ends[stop - 1]
            if size >= BATCH_BYTES:
                yield part << 24 | k, held
                k, held, size = k + 1, [], 0
    if held:
        yield part << 24 | k, held


def perplexities(df: DataFrame, model: Model, text: str = "text", out: str = "perplexity", keep_text: bool = True) -> DataFrame:
    """``df`` with the perplexity of its whole ``text``, a unit and the end of a text; null counts as empty: its end alone.

    ``keep_text`` false leaves the text out. ``df`` is read twice and must give the same rows in the same tasks each time, as
    a table in files does; a batch that does not get all it asked for raises an error. A column named ``out`` is replaced.
    """
    df = df.drop(out)
    place = df.columns.index(text)
    schema = df.schema if keep_text else df.drop(text).schema

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in in_batches(batches, 0):
            tally = Tally()
            for piece in held:
                for t in piece.column(0):
                    tally.add(t.as_py())
            tally.merge()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tally.seen), number)), pa.array(tally.seen.view(np.int64))], ["batch", "gram"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in in_batches(batches, place):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for piece in held:
                    writer.write_batch(piece)
            rows = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([rows], pa.binary())], ["batch", "rows"])

    def add_up(packed: pa.Table, answers: pa.Table) -> pa.Table:
        known = answers.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, cost, out_rows = known[order], answers.column("cost").to_numpy()[order], []
        for rows in packed.column("rows"):
            for batch in pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows.as_buffer())):
                found = np.empty(batch.num_rows)
                for k, t in enumerate(batch.column(place)):
                    g, total = grams(t.as_py()), 0.0
                    for a in range(0, len(g), AT_ONCE):
                        part = g[a : a + AT_ONCE]
                        at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                        if not (known[at] == part).all():
                            raise ValueError("a batch was not the same when read again")
                        total += cost[at].sum()
                    found[k] = np.exp(total / len(g))
                columns = [c for k, c in enumerate(batch.columns) if keep_text or k != place]
                out_rows.append(pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*schema.names, out]))
        return pa.Table.from_batches(out_rows)

    asked = staged(df.select(text).mapInArrow(ask, "batch long, gram long"), "asked")
    answers = asked.join(costs(asked.select("gram").distinct(), model), "gram").select("batch", "gram", "cost")
    packed = df.mapInArrow(pack, "batch long, rows binary")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(add_up, f"{fields}, `{out}` double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that ``labels`` (doc_id, quality) call good and never bad."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")


def thresholds(trusted: DataFrame, quantile: float = QUANTILE) -> tuple[dict[str, float], float]:
    """Each language's limit, and that of other languages, from trusted documents' perplexities (lang, perplexity).

    A language's limit is the mean of its own quantile and that of all languages, the latter weighted as PRIOR documents, so
    a language with few trusted documents takes over the common limit by degrees. A row for each language comes to the driver.
    """
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("at")
    overall = trusted.agg(at).first()["at"]
    if overall is None:
        return {}, float("inf")
    by = trusted.where("lang is not null").groupBy("lang").agg(at, F.count("*").alias("n"))
    return {r.lang: (r.n * r["at"] + PRIOR * overall) / (r.n + PRIOR) for r in by.collect()}, overall


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, keep_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, lang and any others) with perplexity, threshold and keep; without ``text`` if ``keep_text`` is false.

    Nulls: a null text counts as empty; a null or untrusted language takes all languages' threshold; a null id is never
    trusted. Without any trusted document all are kept. Repeated rows and extra columns pass; columns so named are replaced.
    """
    docs = docs.drop("perplexity", "threshold", "keep")
    ids = staged(trusted_ids(labels), "trusted")
    ids = within(ids, MOST_TRUSTED)
    model = fit(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
    scored = staged(perplexities(docs, model, keep_text=keep_text), "perplexity")
    limits, overall = thresholds(scored.select("doc_id", "lang", "perplexity").join(ids, "doc_id", "left_semi"), quantile)
    pairs = [x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]
    own = F.try_element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(None).cast("double")
    return scored.withColumn("threshold", F.coalesce(own, F.lit(overall))).withColumn("keep", F.col("perplexity") <= F.col("threshold"))
