"""Language of texts: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is its lower-cased letters with one blank for whatever stands between words; its n-grams of ORDERS characters go to
DIMS buckets. A bucket's term frequency is its share of the text's n-grams weighted by idf, so a text's logits are sums
over its n-grams and need no list of its distinct ones. Weights are trained by follow-the-regularised-leader with an elastic net:
each weight is the closed-form minimiser of all its gradients so far, an L1 and an L2 term, so rare n-grams stay at 0. A temperature fitted on texts
that training left out then calibrates the probabilities.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.llm.shared import within

ORDERS = (1, 2, 3, 4)
BITS = 18
DIMS = 1 << BITS
PIECE = 1 << 18  # characters that are looked at together; the edges of a piece are edges of words
LANGUAGE_ROWS, SAMPLE_ROWS = 600, 3000  # rows of a language, and in all, that the weights are fitted on
UNKNOWN = "und"
SCALE = 20.0  # of a text's TF-IDF vector, whose entries sum to this


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every text, texts in turn, DIMS where there is none, one row for each order; where each text's begin."""
    lows = [t.lower() for t in texts]
    flat = np.frombuffer("".join(["\0" + t for t in lows]).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.zeros(len(flat), bool)
    begins[np.cumsum([0, *(len(t) + 1 for t in lows)])[:-1]] = True
    letter = letters()[flat]
    keep = letter | begins
    keep[1:] |= letter[:-1]
    x, letter, begins = np.where(letter, flat, 0)[keep].astype(np.uint32), letter[keep], begins[keep]
    owner = np.cumsum(begins)
    out, h = np.full((len(ORDERS), len(x)), DIMS, np.int32), np.full(len(x), 2166136261, np.uint32)
    for n in range(1, ORDERS[-1] + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ x[n - 1 :]) * np.uint32(16777619)
        if n in ORDERS:
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
            ok = owner[:m] == owner[n - 1 :] if n > 1 else letter
            out[ORDERS.index(n), :m] = np.where(ok, mixed >> np.uint32(32 - BITS), DIMS)
    return out, np.flatnonzero(begins)


def slices(texts: pa.Array, chars: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and pieces of texts, about so many characters at once; a long text comes in several pieces, one after the other."""
    rows, parts, held = [], [], 0
    for k, t in enumerate(texts):
        t = t.as_py() or ""
        for a in range(0, max(len(t), 1), chars):
            rows.append(k)
            parts.append(t[a : a + chars])
            held += len(parts[-1])
            if held >= chars:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


def bags(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, distinct buckets and their counts of every text in turn."""
    row, bag = -1, None
    for rows, parts in slices(texts):
        found, begins = buckets(parts)
        for k, own in zip(rows, np.split(found, begins[1:], axis=1)):
            b, n = np.unique(own, return_counts=True)
            b, n = (b[:-1], n[:-1]) if len(b) and b[-1] == DIMS else (b, n)
            if k == row:
                b, place = np.unique(np.concatenate([bag[0], b]), return_inverse=True)
                bag = b, np.bincount(place, np.concatenate([bag[1], n]), len(b)).astype(np.int64)
            else:
                if bag is not None:
                    yield row, *bag
                row, bag = k, (b, n)
    if bag is not None:
        yield row, *bag


def texts_with(df: DataFrame, text: str) -> DataFrame:
    """How many texts have each bucket: bucket, n; bucket DIMS, which stands at every text's beginning, counts them. A partition gives one row for each bucket that it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros(DIMS + 1, np.int64), np.full(DIMS + 1, -1, np.int64)
        serial, at = 0, np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            before = -1
            for rows, parts in slices(batch.column(0)):
                found, begins = buckets(parts)
                for k, own in zip(rows, np.split(found, begins[1:], axis=1)):
                    serial, before = serial + (k != before), k
                    b = own.ravel()
                    b = b[seen[b] != serial]
                    at[b] = np.arange(len(b))  # of equal buckets the last one's place stays
                    b = b[at[b] == np.arange(len(b))]
                    seen[b] = serial
                    n[b] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(n[some])})

    return df.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def inverse_frequency(n: dict[int, int]) -> np.ndarray:
    df = np.zeros(DIMS, np.float64)
    df[[b for b in n if b < DIMS]] = [c for b, c in n.items() if b < DIMS]
    return np.log((1 + n.get(DIMS, 0)) / (1 + df)) + 1


@dataclass
class Model:
    languages: list[str]  # in order
    table: np.ndarray  # a row for each bucket, and one of zeros: idf times weight for each language, idf
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, sums: np.ndarray) -> np.ndarray:
        """Of rows of sums over a text's n-grams."""
        return SCALE * sums[:, :-1] / np.maximum(sums[:, -1:], 1e-12) + self.bias

    def sums(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), self.table.shape[1]))
        for rows, parts in slices(texts, max(PIECE // max(len(self.languages), 1), 1 << 12)):
            found, begins = buckets(parts)
            for own in found:
                np.add.at(out, rows, np.add.reduceat(self.table[own], begins, axis=0, dtype=np.float64))
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text; ties go to the first language."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(self.sums(texts)) / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[k] for k in best], p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 4, rate: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMS, k) and biases of rows (buckets, values) with classes y; the biases carry no penalty."""
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))  # the last row is the bias

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / rate + l2)
        w[np.abs(z[at]) <= l1] = 0
        w[-1] = -z[DIMS] * rate / (beta + np.sqrt(n[DIMS]))
        return w

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x = np.append(rows[r][0], DIMS), np.append(rows[r][1], 1.0)
            w = weights(at)
            g = softmax(x @ w)
            g[y[r]] -= 1
            g = x[:, None] * g
            grown = n[at] + g**2
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / rate * w
            n[at] = grown
    w = weights(np.arange(DIMS + 1))
    return w[:-1], w[-1]


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature at which logits z give classes y the largest likelihood, by golden sections of its logarithm; 1 without rows.

    As one row more of each class might have shown otherwise, a class counts as 1 / (rows + 2) less than sure; without that,
    rows that are all right would ask for a temperature of 0.
    """
    if not len(y) or z.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(y) + 2)
    target = np.full(z.shape, doubt / (z.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - doubt

    def loss(t: float) -> float:
        scaled = (z - z.max(axis=1, keepdims=True)) / np.exp(t)
        return float((target * (np.log(np.exp(scaled).sum(axis=1, keepdims=True)) - scaled)).sum())

    low, high, cut = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def sample(df: DataFrame, most: int) -> DataFrame:
    """Of the rows of each ``lang`` at most ``most``, the first by a hash of id and text. Most rows go by their hash alone, before any is sorted."""
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    n = df.groupBy("lang").agg(F.count("*").alias("_n")).withColumnRenamed("lang", "_lang")
    near = df.withColumn("_h", order).join(within(n, 10_000), F.col("lang") == F.col("_lang"))
    near = near.where(F.col("_h") < F.lit(1 << 30) * (2.0 * most + 50) / F.col("_n"))
    return near.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))).where(F.col("_place") <= most).select(*df.columns, "_place")


def fit(df: DataFrame, per_language: int = LANGUAGE_ROWS, in_all: int = SAMPLE_ROWS) -> Model:
    """A model of the languages in ``df`` (doc_id, text, lang); rows without text or language teach nothing.

    Document frequencies are of all rows. Weights are fitted on a bounded sample: at most ``per_language`` rows of a language and about ``in_all`` in all
    (one at least of each language), a fifth of which only sets the temperature. The driver gets DIMS counts and the sample's n-gram counts,
    never texts. No row gives a model that knows no language.
    """
    rows = df.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((DIMS + 1, 1), np.float32), np.zeros(0))
    idf = inverse_frequency({r.bucket: r.n for r in texts_with(rows, "text").collect()})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b, n in bags(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, 1), batch.column(2).slice(k, 1), pa.array([b.astype("<i4").tobytes()], pa.binary()), pa.array([n.astype("<i4").tobytes()], pa.binary())], ["lang", "place", "buckets", "counts"])

    some = sample(rows, max(1, min(per_language, in_all // len(languages)))).select("text", "lang", "_place")
    taken = sorted(tuple(r) for r in some.mapInArrow(counted, "lang string, place int, buckets binary, counts binary").collect())
    y = np.array([languages.index(r[0]) for r in taken])
    aside = np.array([r[1] % 5 == 0 for r in taken])
    x = []
    for _, _, b, n in taken:
        b = np.frombuffer(b, "<i4")
        v = np.frombuffer(n, "<i4") * idf[b]
        x.append((b, SCALE * v / max(v.sum(), 1e-12)))
    weight, bias = ftrl([v for v, a in zip(x, aside) if not a], y[~aside], len(languages))
    z = np.array([v @ weight[b] for b, v in x]).reshape(len(x), -1) + bias
    table = np.zeros((DIMS + 1, len(languages) + 1), np.float32)
    table[:DIMS] = np.column_stack([weight * idf[:, None], idf])
    return Model(languages, table, bias, calibrated(z[aside], y[aside]))


def identify(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``df`` with struct ``out`` (lang, score): the likeliest language of the whole text and its calibrated probability.

    A text without a letter, or null, is UNKNOWN with score 0, as is every text where the model knows no language. A column
    named ``out`` is replaced; repeated rows and other columns pass, an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIMS rows, a number for each language in each

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lang, score = shared.value.predict(texts)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    own = F.col(f"`{text}`")
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    return df.withColumn(out, F.when(F.coalesce(own.rlike(r"\p{L}"), F.lit(False)), of(own)).otherwise(none))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of training: crc32 of its id as text (null: empty) leaves 2 modulo 4."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 4 == 2
