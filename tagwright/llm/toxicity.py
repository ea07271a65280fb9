"""Toxicity: bags of subwords, averaged embeddings and a linear softmax, trained jointly in numpy.

A text is the bag of its words' subwords: each word with marks at its ends, and all its character n-grams, however long
it is (a text without blanks is one word), each hashed to one
of ``BUCKETS`` vectors. The mean vector goes through a linear layer and a softmax over (clean, toxic). A word that was
never seen, such as a misspelling, is scored by the n-grams that it shares with seen ones.

As all is linear before the softmax, a trained model is a number a bucket and a bias: a worker keeps a word's sum and
count, and a text costs a table look-up for each of its words.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.shared import staged

SHORTEST, LONGEST = 3, 5  # characters of an n-gram, marks included
BUCKETS = 1 << 17
KEPT_WORDS = 200_000
KEPT_LENGTH = 64  # characters of a word that a worker remembers; longer ones are scored each time
LONG = 1000  # characters from which a word's n-grams are found by sorting
EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())


def subwords(word: str) -> list[int]:
    """Buckets of the whole word with its marks and of its distinct n-grams."""
    if len(word) > LONG:
        return subwords_of_long(word)
    marked = f"<{word}>".encode() if word.isascii() else f"<{word}>"
    grams = {marked[k : k + n] for n in range(SHORTEST, LONGEST + 1) for k in range(len(marked) - n + 1)} | {marked}
    return [zlib.crc32(g if isinstance(g, bytes) else g.encode()) & BUCKETS - 1 for g in grams]


def subwords_of_long(word: str) -> list[int]:
    """The same for a word of any length: distinct n-grams are found by sorting numbers, not in a set of strings."""
    marked = f"<{word}>"
    x = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.int64)
    out = [zlib.crc32(marked.encode()) & BUCKETS - 1]
    for n in range(SHORTEST, LONGEST + 1):
        rank = np.zeros(len(x) - n + 1, np.int64)
        for k in range(n):  # rank of the first k + 1 characters; below the word's length, so that this fits in 64 bits
            rank = np.unique(rank << 21 | x[k : k + len(rank)], return_inverse=True)[1]
        starts = np.unique(rank, return_index=True)[1]
        out += [zlib.crc32(marked[a : a + n].encode()) & BUCKETS - 1 for a in starts.tolist()]
    return out


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Model:
    weight: np.ndarray  # a bucket's part of (toxic - clean) before the mean
    bias: float


class Runs:
    """Rows of numbers of different lengths, one after the other."""

    def __init__(self, values: array, sizes: array):
        self.ends = np.cumsum([0, *sizes])
        self.values = np.array(values)

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of these rows stand, in turn, and how many each row has."""
        n = self.ends[rows + 1] - self.ends[rows]
        total = np.cumsum(n)
        return np.repeat(self.ends[rows] - total + n, n) + np.arange(total[-1] if len(total) else 0), n


Packed = tuple[str, bytes]  # distinct words, each on a line, and how often each stands


def packed(text: str | None) -> Packed:
    """A text's words, without marks at their edges, in less room than the text; no word has a line break."""
    bag = Counter(w.strip(EDGES) for w in words_of(text))
    return "\n".join(bag), np.array(list(bag.values()), "<i4").tobytes()


class Bags:
    """Bags of words whose words are bags of buckets, so that a word's n-grams are held once, however many texts have it."""

    def __init__(self, bags: Iterable[Packed]):
        number: dict[str, int] = {}
        held, counts, sizes, grams, gram_sizes = array("i"), array("f"), array("i"), array("i"), array("i")
        for words, n in bags:
            words = words.split("\n") if n else []
            for w in words:
                if w not in number:
                    number[w] = len(number)
                    own = subwords(w)
                    grams.extend(own)
                    gram_sizes.append(len(own))
            held.extend([number[w] for w in words])
            counts.extend(np.frombuffer(n, "<i4").tolist())
            sizes.append(len(words))
        self.words, self.counts, self.grams = Runs(held, sizes), Runs(counts, sizes), Runs(grams, gram_sizes)
        size, ends = np.diff(self.grams.ends), self.words.ends
        self.totals = np.array([max(1.0, float(self.counts.values[a:b] @ size[self.words.values[a:b]])) for a, b in zip(ends, ends[1:])], np.float32)

    def rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, share of its text and place among ``rows`` of every n-gram of these texts."""
        at, n = self.words.places(rows)
        words, owner = self.words.values[at], np.repeat(np.arange(len(rows)), n)
        share = self.counts.values[at] / self.totals[rows][owner]
        at, n = self.grams.places(words)
        return self.grams.values[at], np.repeat(share, n), np.repeat(owner, n)


def train(texts: list[Packed | str | None], labels: list[int], dim: int = 8, steps: int = 1200, batch: int = 64, rate: float = 0.5, seed: int = 7) -> Model:
    """Embeddings and softmax layer of texts or their bags of words, by about ``steps`` minibatches with Adagrad, the classes weighted alike. One class only, or no text: its share."""
    y = np.array(labels, np.int64)
    share = np.bincount(y, minlength=2)
    if not share.all():
        return Model(np.zeros(BUCKETS, np.float32), 5.0 * float(np.sign(share[1] - share[0])))
    bags, r = Bags(t if isinstance(t, tuple) else packed(t) for t in texts), np.random.default_rng(seed)
    embed = r.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    layer, bias = r.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_embed, g_layer, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    weight = (len(y) / (2.0 * share))[y].astype(np.float32)
    for _ in range(max(1, -(-steps * batch // len(y)))):
        order = r.permutation(len(y))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            b, s, row = bags.rows(rows)
            mean = np.stack([np.bincount(row, embed[b, j] * s, len(rows)) for j in range(dim)], axis=1).astype(np.float32)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows, None] / len(rows)
            d_layer, d_bias, d_mean = mean.T @ p, p.sum(axis=0), p @ layer.T
            used, place = np.unique(b, return_inverse=True)
            d_embed = np.stack([np.bincount(place, d_mean[row, j] * s, len(used)) for j in range(dim)], axis=1).astype(np.float32)
            g_layer += d_layer**2
            g_bias += d_bias**2
            g_embed[used] += (d_embed**2).mean(axis=1)
            layer -= 0.1 * d_layer / np.sqrt(g_layer)
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
            embed[used] -= rate * d_embed / np.sqrt(g_embed[used])[:, None]
    return Model(embed @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


class Words(dict):
    """Word -> its subwords' sum (real part) and number (imaginary part); two generations bound the memory."""

    def __init__(self, model: Model):
        super().__init__()
        self.weight, self.bias, self.old = model.weight, model.bias, {}

    def __missing__(self, word: str) -> complex:
        value = self.old.get(word)
        if value is None:
            buckets = subwords(word.strip(EDGES))
            value = complex(float(self.weight[buckets].sum()), len(buckets))
        if len(word) > KEPT_LENGTH:
            return value
        if len(self) >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

    def score(self, text: str | None) -> float:
        total = sum(map(self.__getitem__, words_of(text)), 0j)
        z = (total.real / total.imag if total.imag else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def labelled_sample(docs: DataFrame, labels: DataFrame, clean: int, toxic: int) -> tuple[list[Packed], list[int]]:
    """Of the labelled texts so many of either class, the first by a hash of the id, as bags of words; texts of any length.

    ``docs`` (doc_id, text), ``labels`` (doc_id, toxic); rows without an id or a label, and ids labelled both ways, are not used.
    The driver gets the distinct words of the chosen texts and their counts.
    """
    ids = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    ids = ids.join(docs.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = [ids.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in enumerate((clean, toxic))]
    some = F.broadcast(staged(chosen[0].union(chosen[1]), "sample"))  # clean + toxic rows at most

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, n = packed(batch.column(3)[k].as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), pa.array([words]), pa.array([n])], ["doc_id", "key", "toxic", "words", "counts"])

    found = docs.join(some, "doc_id").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("toxic").cast("int"), "text")
    rows = found.mapInArrow(bags, "doc_id long, key long, toxic int, words string, counts binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.key))
    return [(r.words, bytes(r.counts)) for r in rows], [r.toxic for r in rows]


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with the probability that the whole ``text`` is toxic; a text without words, or null, has the model's bias alone.

    A column named ``out`` is replaced; repeated rows and other columns pass, an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(shared.value)
        for texts in batches:
            yield pa.array([words.score(t.as_py()) for t in texts], pa.float64())

    return df.withColumn(out, of(F.col(f"`{text}`")))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, clean: int = 6000, toxic: int = 2500) -> Model:
    """A model from a bounded sample of labelled texts, see ``labelled_sample``, none of them held out."""
    return train(*labelled_sample(docs.select("doc_id", "text"), labels.where(~held_out()), clean, toxic))
