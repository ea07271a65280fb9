import collections
import itertools
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tagwright.llm import queries, simhash
from tagwright.llm.shared import connected_components

SMALL = "/root/testdata/sf0.001"


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(rows):
    """doc_id -> (fingerprint, smallest reachable doc_id)"""
    fp = [(d, brute_fingerprint(t)) for d, t in rows]
    near = {a: [b for b in {f for _, f in fp} if (a ^ b).bit_count() <= 2] for a in {f for _, f in fp}}
    out = {}
    for d, f in fp:
        seen, todo = {f}, [f]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out[d] = (f"{f:016x}", min(d for d, g in fp if g in seen))
    return out


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, SMALL).collect()}
    assert got == brute_groups(rows)
    assert max(Counter(c for _, c in got.values()).values()) > 1


def test_planted_links(spark):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for _ in range(3):
            f ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(f)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    for bits in (1, 2, 3):
        got = sorted((x.a, x.b) for x in simhash.near_pairs(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), bits).collect())
        assert got == sorted((signed[a], signed[b]) for a in fps for b in fps if signed[a] < signed[b] and (a ^ b).bit_count() <= bits)


def test_the_exploded_index_is_not_broadcast(spark):
    """Spark sizes it as the fingerprints before the explode, far under the limit for a broadcast."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.near_pairs(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_postings_of_texts_are_not_broadcast(spark, monkeypatch):
    plans, staged = {}, simhash.staged

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(simhash, "staged", seen)
    simhash.classes_of_texts(spark.createDataFrame([(k, f"a b c d e f {k}") for k in range(4)], "doc_id long, text string"))
    assert "SortMergeJoin" in plans["postings"] and "Broadcast" not in plans["postings"]


def test_odd_rows(spark):
    rows = [(3, None), (2, ""), (9, " \t"), (5, "One"), (6, "one"), (7, "a b"), (8, "é x y z"), (None, "one"), (5, "One")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, fp string")
    got = simhash.groups(df, 3).collect()
    assert len(got) == len(rows)
    assert {x.component_id for x in got if x.fp == 0} == {2}
    assert {x.component_id for x in got if x.doc_id in (5, 6, None)} == {5}
    assert simhash.groups(df.where("false"), 3).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(200, 400)] + [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(1000, 1000 + k) for k in range(1, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert connected_components(spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))).count() == 0


def jaccard(a, b, n=5):
    x, y = (set(simhash.shingles(t, n)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_all_pairs_of_a_posting_meet(spark, monkeypatch):
    """Texts half alike by a template stand between true pairs in the postings that they share."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    template, rows, true = [word() for _ in range(200)], [], []
    for k in range(700):
        text = template + [word() for _ in range(100)]
        rows.append((2 * k, " ".join(text)))
        if k % 7 == 0:  # 6 words changed: alike by about 0.82
            for at in range(210, 300, 15):
                text = [*text[:at], word(), *text[at + 1 :]]
            rows.append((2 * k + 1, " ".join(text)))
            true.append((2 * k, 2 * k + 1))
    text = dict(rows)
    assert all(jaccard(text[a], text[b]) >= 0.8 for a, b in true)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    names = {t: simhash.set_name(simhash.shingle_set(t, 5)) for t in text.values()}
    keys = [(names[t], int(k)) for t in text.values() for k in simhash.posting_keys(*simhash.wide_and_set(t, 5))]
    none = spark.createDataFrame([], "node long, component long")
    monkeypatch.setattr(simhash, "BLOCK", 3)
    distinct = spark.createDataFrame([(n, *(int.from_bytes(simhash.wide_simhash(t, 5)[8 * k : 8 * k + 8], "little", signed=True) for k in range(4))) for t, n in names.items()], "name long, f0 long, f1 long, f2 long, f3 long")
    got = {(x.a, x.b) for x in simhash.tallied_pairs(spark.createDataFrame(keys, "name long, key long"), none, distinct, 256).collect()}
    want = collections.Counter(pair for _, g in itertools.groupby(sorted(keys, key=lambda x: x[::-1]), key=lambda x: x[1]) for pair in itertools.combinations([n for n, _ in g], 2))
    assert got == {pair for pair, n in want.items() if n >= simhash.LEAST}
    assert sum(tuple(sorted((names[text[a]], names[text[b]]))) in got for a, b in true) >= 0.95 * len(true)
    classes = {x.doc_id: x.class_id for x in simhash.near_duplicate_classes(df).collect()}
    assert len(classes) == len(rows) and sum(classes[a] == classes[b] for a, b in true) >= 0.95 * len(true)


def test_copies_with_changes_of_their_own_form_no_square(spark, monkeypatch):
    """Copies of one text that all lie below 0.8, pair by pair, are near misses in every posting; the alike ones among them still meet."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    template, rows = [word() for _ in range(150)], []
    for k in range(200):
        text = list(template)
        for at in r.sample(range(4, 146, 5), 4):
            text[at] = word()
        rows.append((2 * k, " ".join(text)))
        if k % 10 == 0:
            text[r.randrange(150)] = word()
            rows.append((2 * k + 1, " ".join(text)))
    alike, verified = simhash.alike, []

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(simhash, "alike", counted)
    classes = {x.doc_id: x.class_id for x in simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    true = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if jaccard(s, t) >= 0.8]
    assert len(true) >= 20 and all(classes[a] == classes[b] for a, b in true)
    assert len(set(classes.values())) == len(rows) - len(true)
    assert verified[1] <= len(rows)


def test_sets_that_may_be_alike_share_a_rare_hash(spark):
    """Of sets of all sizes no pair at 0.8 or more is left out, in the order of rarity that the sets themselves give."""
    r = random.Random(14)
    pool, sets = list(range(60)), {}
    for k in range(80):
        sets[k] = set(r.sample(pool, r.randint(1, 40)))
        for j in range(1, 4):
            sets[1000 * j + k] = {x for x in sets[k] if r.random() > 0.06} | {r.choice(pool)}
    rare = simhash.rarest(spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "name long, hashes array<long>"), 0.8)
    rows = spark.createDataFrame([(key, k, k, len(sets)) for k in sets for key in (1, 2)], "key long, name long, component long, size long")
    flat = spark.createDataFrame([(k, 0, 0, 0, 0) for k in sets], "name long, f0 long, f1 long, f2 long, f3 long")
    got = {(x.a, x.b) for x in simhash.meeting_pairs(rows, flat, 256, 2, rare, 0.8).collect()}
    true = {tuple(sorted(p)) for p in itertools.combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    assert len(true) > 100 and true <= got
    assert len(got) < len(sets) * (len(sets) - 1) / 4
    some = rare.where("name < 1000")
    assert {(a, b) for a in sets for b in sets if a < b and b >= 1000} <= {(x.a, x.b) for x in simhash.meeting_pairs(rows, flat, 256, 2, some, 0.8).collect()}


def test_classes_link_only_what_is_alike(spark):
    """Pairs at 0.7 and texts that share a repeated line stay apart; sets that are alike by 0.8 meet."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(60):
        text = [word() for _ in range(400)]
        rows.append((3 * k, " ".join(text)))
        for j, changed in ((1, 14), (2, 7)):
            copy = list(text)
            for at in range(20, 20 + 25 * changed, 25):
                copy[at] = word()
            rows.append((3 * k + j, " ".join(copy)))
    line = " ".join(word() for _ in range(8))
    rows += [(1000 + k, " ".join([line] * 40 + [word() for _ in range(30)])) for k in range(10)]
    text = dict(rows)
    parent = {d: d for d in text}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in text:
        for b in text:
            if a < b and (a // 3 == b // 3 or min(a, b) >= 1000) and jaccard(text[a], text[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {d: find(d) for d in text}
    got = {x.doc_id: x.class_id for x in simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert any(want[d] != d for d in text)
    assert all(want[got[d]] == want[d] for d in text)  # nothing unlike is linked
    assert sum(got[d] == want[d] for d in text) >= 0.97 * len(text)
    odd = [(3, None), (2, ""), (5, "One"), (6, "one"), (None, "one"), (5, "One")]
    got = simhash.near_duplicate_classes(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 2), (2, 2), (5, 5), (6, 5), (None, 5), (5, 5)], key=str)
    assert simhash.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
