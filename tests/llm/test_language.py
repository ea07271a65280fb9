"""Language identification against plain versions, and how often it is right on documents that training left out."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagwright.llm import language, queries

LARGER = "/root/testdata/sf0.01"
TEXTS = ["Der Hund läuft über die Straße.", "", "  ", "123 !?", "a", "Ünder  the-bridge\n\nétage", "ab" * 50, None, "Привет, мир", "日本語 text", "éte", "x\0y", "😀 ok", "İstanbul"]


def plain_grams(text):
    """n-gram -> how often, of a text's letters with one blank between words, a blank before the first."""
    x, after_letter = "\0", False
    for c in (text or "").lower():
        if language.letters()[ord(c)]:
            x, after_letter = x + c, True
        elif after_letter:
            x, after_letter = x + "\0", False
    return Counter(x[k : k + n] for n in language.ORDERS for k in range(len(x) - n + 1) if x[k : k + n] != "\0")


def plain_bucket(gram):
    h = 2166136261
    for c in gram:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return ((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - language.BITS


def plain_bag(text):
    out = Counter()
    for gram, n in plain_grams(text).items():
        out[plain_bucket(gram)] += n
    return out


def test_buckets_are_the_plain_ones():
    got = {k: Counter(dict(zip(b.tolist(), n.tolist()))) for k, b, n in language.bags(pa.array(TEXTS))}
    assert got == {k: plain_bag(t) for k, t in enumerate(TEXTS)}


def test_a_long_text_is_read_whole(monkeypatch):
    monkeypatch.setattr(language.slices, "__defaults__", (1000,))
    text = "".join(random.Random(1).choice("abc dé.") for _ in range(3500))
    want = Counter()
    for a in range(0, len(text), 1000):
        want += plain_bag(text[a : a + 1000])
    assert [Counter(dict(zip(b.tolist(), n.tolist()))) for _, b, n in language.bags(pa.array([text]))] == [want]


def test_document_frequencies_are_the_plain_ones(spark):
    texts = TEXTS + ["same words same", "same"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.bucket: r.n for r in language.texts_with(df, "text").collect()}
    want = Counter(b for t in texts for b in plain_bag(t))
    assert got == want | {language.DIMS: len(texts)}
    assert language.texts_with(df.where("false"), "text").count() == 0


def test_training_is_the_plain_loop():
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(30, 5, replace=False)).astype(np.int32), r.random(5)) for _ in range(25)]
    y = r.integers(0, 3, 25)
    rate, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, n = Counter(), Counter()

    def w(j, k):
        if j == "bias":
            return -z[j, k] * rate / (beta + math.sqrt(n[j, k]))
        return 0.0 if abs(z[j, k]) <= l1 else -(z[j, k] - math.copysign(l1, z[j, k])) / ((beta + math.sqrt(n[j, k])) / rate + l2)

    order = np.random.default_rng(5)
    for _ in range(4):
        for i in order.permutation(25):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), ("bias", 1.0)]
            now = {(j, k): w(j, k) for j, _ in x for k in range(3)}
            e = [math.exp(sum(now[j, k] * v for j, v in x)) for k in range(3)]
            for j, v in x:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (y[i] == k))
                    z[j, k] += g - (math.sqrt(n[j, k] + g * g) - math.sqrt(n[j, k])) / rate * now[j, k]
                    n[j, k] += g * g
    weight, bias = language.ftrl(rows, y, 3)
    assert np.allclose(bias, [w("bias", k) for k in range(3)])
    assert np.allclose(weight[:30], [[w(j, k) for k in range(3)] for j in range(30)]) and not weight[30:].any()


def test_penalties_leave_weights_at_zero():
    rows = [(np.array([k % 2, 2 + k]), np.array([1.0, 0.01])) for k in range(40)]
    weight, _ = language.ftrl(rows, np.arange(40) % 2, 2)
    assert (weight[:2] != 0).all() and not weight[2:].any()


def test_temperature_is_the_best_of_a_grid():
    r = np.random.default_rng(4)
    z = r.normal(0, 4, (200, 3))
    y = np.array([r.choice(3, p=language.softmax(row / 2.5)) for row in z])
    loss = lambda t: -np.log(language.softmax(z / t)[np.arange(200), y]).mean()
    best = min(np.exp(np.linspace(-2, 3, 400)), key=loss)
    assert abs(language.calibrated(z, y) / best - 1) < 0.1
    assert language.calibrated(z[:0], y[:0]) == 1.0
    sure = np.eye(3)[y] * 4
    assert language.softmax(sure / language.calibrated(sure, y)).max() < 1 - 1 / 500


def test_scores_are_the_plain_ones():
    r = np.random.default_rng(6)
    table = np.zeros((language.DIMS + 1, 3), np.float32)
    table[:-1] = r.random((language.DIMS, 3))
    model = language.Model(["x", "y"], table, np.array([0.1, -0.2]), 1.7)
    lang, score = model.predict(pa.array(TEXTS))
    for text, got, p in zip(TEXTS, lang, score):
        sums = sum((n * table[b].astype(float) for b, n in plain_bag(text).items()), np.zeros(3))
        z = (language.SCALE * sums[:2] / max(sums[2], 1e-12) + model.bias) / 1.7
        want = np.exp(z) / np.exp(z).sum()
        assert got == "xy"[want.argmax()] and abs(p - want.max()) < 1e-6


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet")


def test_held_out_documents_are_identified(spark, docs):
    got = {r.doc_id: r for r in queries.queries()["op13_language"](spark, LARGER).collect()}
    told = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == told.keys()
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1 for d in got)
    out = [d for d in got if got[d].held_out]
    assert sum(got[d].lang_pred == told[d] for d in out) >= 0.97 * len(out) and len(out) > 150


def test_odd_rows_and_tables(spark, docs):
    model = language.fit(docs.where(~language.held_out()), in_all=200)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " 12 ... \U0001f600"), (4, "é"), (None, "der die und"), (5, "und " * 200_000), (5, "und " * 200_000)], "doc_id long, text string").withColumns({"language": F.lit("clash"), "lang": F.lit("fr")})
    got = [(r.doc_id, r.language.lang, r.language.score) for r in language.identify(odd, model).collect()]
    assert len(got) == 7 and {g[0]: g[1:] for g in got if g[0] in (1, 2, 3)} == {k: ("und", 0.0) for k in (1, 2, 3)}
    assert all(lang in model.languages and 0 < s <= 1 for k, lang, s in got if k not in (1, 2, 3))
    assert language.identify(odd.where("false"), model).count() == 0
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.languages == [] and {r.language.lang for r in language.identify(odd, none).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'de'"), in_all=50)
    assert {r.language.lang for r in language.identify(odd.where("doc_id > 3"), one).collect()} == {"de"}


def test_labels_of_held_out_documents_change_nothing(spark, docs):
    changed = docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    a, b = (language.fit(x.where(~language.held_out()), in_all=100) for x in (docs, changed))
    assert a.languages == b.languages and a.temperature == b.temperature and (a.table == b.table).all()


def test_sample_is_bounded(spark, docs):
    n = {r.lang: r.n for r in language.sample(docs.select("doc_id", "text", "lang"), 40).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert all(v <= 40 for v in n.values()) and len(n) == 4 and sum(n.values()) > 120
