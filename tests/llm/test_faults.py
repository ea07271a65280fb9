"""Faults once found, and the toxicity model against plain loops."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tagwright.llm import decontaminate, simhash, toxicity


def test_an_item_may_repeat_thousands_of_times(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, " ".join([item] * 5000)), (2, item)], "doc_id long, text string")
    got = {r.doc_id: r.hits for r in decontaminate.find(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert sorted(h.start_word for h in got[1]) == list(range(0, 50_000, 10)) and {h.edits for h in got[1]} == {0}
    assert len(got[2]) == 1


def test_a_repeated_id_loses_no_text(spark):
    a, b, c = ("".join(f"{p}{k} " for k in range(40)) for p in "abc")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (1, c, "x"), (None, a, "x"), (8, a + "more", "x"), (9, b, "x"), (9, c, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string").withColumns({"text_key": F.lit("clash"), "class_id": F.lit(3)})
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (1, c), (None, a)], key=str)
    assert simhash.one_of_each(docs).columns == docs.columns


def test_two_texts_of_one_class_and_id_leave_one(spark):
    a = "".join(f"w{k} " for k in range(60))
    docs = spark.createDataFrame([(1, a), (1, a + "end"), (2, a)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.one_of_each(docs).collect()] == [1]


def test_long_texts_teach_toxicity(spark):
    docs = spark.createDataFrame([(k, ("vile " if k % 2 else "nice ") * 4000) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic long")
    words = toxicity.Words(toxicity.fit(docs, labels))
    assert words.score("vile") > 0.7 > 0.3 > words.score("nice")


def test_toxicity_scores_are_plain_sums():
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32), -0.3)
    words = toxicity.Words(model)
    for text in ("You (are) GREAT, great!", "", None, "é", "x" * 3000, "a  b\tc\na"):
        own = [b for w in (text or "").lower().split() for b in toxicity.subwords(w.strip(toxicity.EDGES))]
        z = sum(float(model.weight[b]) for b in own) / len(own) + model.bias if own else model.bias
        assert abs(words.score(text) - 1 / (1 + math.exp(-z))) < 1e-6


def test_toxicity_training_is_the_plain_loop():
    texts, labels = ["bad awful bad", "nice day", "bad day", "a nice one", ""], [1, 0, 1, 0, 0]
    model = toxicity.train(texts, labels, dim=2, steps=6, batch=2, rate=0.5, seed=3)
    r = np.random.default_rng(3)
    embed = r.normal(0, 0.1, (toxicity.BUCKETS, 2)).astype(np.float32)
    layer, bias = r.normal(0, 0.5, (2, 2)).astype(np.float32), np.zeros(2)
    g_embed, g_layer, g_bias = Counter(), np.full((2, 2), 1e-6), np.full(2, 1e-6)
    weight = [5 / (2 * labels.count(y)) for y in labels]
    for _ in range(3):
        order = r.permutation(5)
        for k in range(0, 5, 2):
            rows = order[k : k + 2].tolist()
            grams = [[b for w in texts[t].split() for b in toxicity.subwords(w)] for t in rows]
            d_layer, d_bias, d_embed = np.zeros((2, 2)), np.zeros(2), {}
            for t, own in zip(rows, grams):
                mean = sum((embed[b].astype(float) for b in own), np.zeros(2)) / max(1, len(own))
                e = np.exp(mean @ layer + bias)
                d = (e / e.sum() - np.eye(2)[labels[t]]) * weight[t] / len(rows)
                d_layer += np.outer(mean, d)
                d_bias += d
                for b in own:
                    d_embed[b] = d_embed.get(b, 0) + layer @ d / len(own)
            g_layer, g_bias = g_layer + d_layer**2, g_bias + d_bias**2
            layer, bias = layer - 0.1 * d_layer / np.sqrt(g_layer), bias - 0.1 * d_bias / np.sqrt(g_bias)
            for b, d in d_embed.items():
                g_embed[b] = g_embed.get(b, 1e-6) + (d**2).mean()
                embed[b] -= 0.5 * d / math.sqrt(g_embed[b])
    used = sorted(g_embed)
    assert np.allclose(model.weight[used], (embed @ (layer[:, 1] - layer[:, 0]))[used], atol=1e-4) and abs(model.bias - (bias[1] - bias[0])) < 1e-4
