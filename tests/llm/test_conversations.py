"""Repair of conversations against an exhaustive search, and their prefix trie against plain dictionaries."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagwright.llm import prefix_trie, queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"
NEXT = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def faults(rows):
    """First fault of each row (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        end = text.strip(BLANKS)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by Dijkstra over (row, state), the audit a part of the distance: no fold."""
    fault = faults(rows)
    heap, done = [(0, "", 0, "n", ())], set()
    while heap:
        cost, audit, k, state, out = heapq.heappop(heap)
        if k == len(rows) and state in "na":
            return cost, audit, out
        if (k, state) in done:
            continue
        done.add((k, state))
        for role in ("user", "assistant"):
            if to := NEXT.get((state, role[0])):
                heapq.heappush(heap, (cost + 3, audit + "I", k, to, (*out, (role, ""))))
        if k < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state, out))
            if fault[k] not in ("blank", "duplicate"):
                extra = 3 * (fault[k] == "truncated")
                for edit, role, more in (("K", rows[k][0], 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if to := NEXT.get((state, role[:1])):
                        heapq.heappush(heap, (cost + more + extra, audit + edit, k + 1, to, (*out, (role, rows[k][1]))))


def plain_repair(rows):
    """Of rows (turn, role, text) of one conversation in order: what ``repair`` returns."""
    texts = [(role, text) for _, role, text in rows]
    turns = [t for t, _, _ in rows if t is not None]
    fault = faults(texts)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(texts, texts[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), *cheapest(texts))


def by_turn(rows):
    return sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def got_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, tuple((x.role, x.text) for x in r.repaired)) for r in df.collect()}


def test_repair_is_the_cheapest(spark):
    r = random.Random(4)
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "useful"])
    text = lambda: r.choice(["a.", "b.", "c!", "d? \n", "cut", "cut off ", "", " \t", "é.", "e. ", " ", None, f"{r.random()}."])
    convs = {c: [(r.choice([None, *range(9)]), role(), text()) for _ in range(r.randrange(1, 10))] for c in range(400)}
    convs[None] = [(1, "user", "no id."), (2, "assistant", "none.")]
    convs[-7] = [(-5, "user", "x."), (3, "assistant", "y.")]
    df = spark.createDataFrame([(c, *row) for c, rows in convs.items() for row in rows], SCHEMA).withColumns({"place": F.lit(1), "fault": F.lit("x"), "here": F.lit(0)})
    assert got_of(repair.repair(df)) == {c: plain_repair(by_turn(rows)) for c, rows in convs.items()}


def test_repair_of_long_empty_and_lost_conversations(spark):
    r = random.Random(5)
    rows = [(t, r.choice(["user", "assistant", "system"]), r.choice(["a.", f"{t}.", f"{t}", " "])) for t in range(3000)]
    df = spark.createDataFrame([(1, *row, 1) for row in rows] + [(2, 0, "user", "gone.", 0)], SCHEMA + ", copies int")
    got = got_of(repair.repair(df, "copies"))
    assert got[1] == plain_repair(by_turn(rows))
    assert got[2] == (0, 0, 0, 0, 0, 0, "", ())
    assert repair.repair(df.where("false"), "copies").count() == 0
    assert repair.repair(df, "copies").where("conv_id = 2").select(repair.digest()).first()[0] == hashlib.sha256(b"").hexdigest()


def test_damage_follows_the_key(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in [None, *range(40)] for t in [None, 1, 2]]
    got = sorted(map(tuple, repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want.append((c, t, "user" if kind == 4 else role, {1: "", 2: "One Two"}.get(kind, text), {0: 0, 3: 2}.get(kind, 1)))
    assert got == sorted(want, key=str) and {w[4] for w in want} == {0, 1, 2}


def test_repair_moves_rows_once(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.")], SCHEMA)
    assert repair.repair(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def plain_trie(convs):
    """RESULT rows of conversations {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            members[turns[:d]].append((c, len(turns)))
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c, n in own if n == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(c for c, _ in own), len(node), min(c for c, _ in members[node[:-1]]) if node else None, len(own), len(children[node]), sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_convs(r, n):
    turn = lambda: (r.choice(["user", "assistant", ""]), r.choice(["", "a", "bé", "c", "dd"]))
    heads = [tuple(turn() for _ in range(r.randrange(6))) for _ in range(5)]
    return [(c, (r.choice(heads) + tuple(turn() for _ in range(r.choice([0, 0, 1, 3])))) if c % 3 else heads[0]) for c in r.sample(range(-n, 3 * n), n)]


def path_of(turns):
    return b"".join(hashlib.sha256(f"{len(a)}:{a}{b}".encode()).digest()[: prefix_trie.NAME] + len(b.encode()).to_bytes(prefix_trie.LENGTH, "big") for a, b in turns)


@pytest.mark.parametrize("seed", range(12))
def test_sweeps_and_stitches_of_any_cut(monkeypatch, seed):
    """However the sorted paths are cut into partitions, and however few children a node holds back, the nodes are the same."""
    r = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "PENDING", r.choice([1, 2, 3, 1000]))
    convs = some_convs(r, r.choice([1, 5, 60]))
    ordered = sorted((path_of(t), c) for c, t in convs)
    cuts = sorted(r.randrange(len(ordered) + 1) for _ in range(r.randrange(7)))
    rows = []
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ordered)])):
        sweep = prefix_trie.Sweep(part)
        for path, c in ordered[a:b]:
            sweep.take(c, path)
        sweep.end()
        rows += sweep.out
    names = prefix_trie.COLUMNS.names
    rows = [dict(zip(names, x)) for x in rows]
    ends, parts = defaultdict(list), {}
    for x in rows:
        if x["kind"] == prefix_trie.END:
            ends[x["id"]].append(x["conv_id"])
        elif x["kind"] == prefix_trie.OPEN:
            p = parts.setdefault(x["id"], x | {"at": (x["part"], x["row"]), "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0})
            p["at"] = min(p["at"], (x["part"], x["row"]))
            p["conv_id"] = min([v for v in (p["conv_id"], x["conv_id"]) if v is not None], default=None)
            for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                p[k] += x[k]
    for name, p in parts.items():
        p["ends_sha256"] = hashlib.sha256(",".join(map(str, sorted(ends[name]))).encode()).hexdigest()
    in_order = sorted(parts.values(), key=lambda p: (p["at"], p["depth"]))
    stacks = [x for batch in prefix_trie.stitched(iter([prefix_trie.batch_of([tuple(p[k] for k in names) for p in in_order])])) for x in batch.to_pylist()]
    named = {x["id"]: x["conv_id"] for x in [*stacks, *(x for x in rows if x["kind"] == prefix_trie.NAMED)]}
    got = [x | {"parent_conv_id": named[x["parent_id"]] if x["parent_id"] is not None else x["parent_conv_id"]} for x in rows if x["kind"] == prefix_trie.NODE] + stacks
    assert sorted((tuple(x[k] for k in prefix_trie.RESULT) for x in got), key=str) == plain_trie(convs)


def test_trie_over_partitions_is_the_plain_one(spark):
    r = random.Random(9)
    convs = some_convs(r, 300) + [(7_000 + k, (("user", "hot"), ("assistant", "the same"))) for k in range(200)] + [(9_000, tuple(("user", str(k)) for k in range(150)))]
    df = spark.createDataFrame([(c, path_of(t)) for c, t in convs], "conv_id long, path binary").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, prefix_trie.trie(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_trie(convs)
    assert prefix_trie.trie(df.where("false")).count() == 0


def test_paths_and_heads(spark):
    r = random.Random(10)
    rows = [(c, r.choice([None, *range(20)]), r.choice(["user", None, ""]), r.choice([None, "x", "yy", f"{r.random()}"])) for c in [*range(-6, 25), None] for _ in range(r.randrange(12))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit("clash"), "base": F.lit("clash"), "key": F.lit(1)})
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, path_of([(role or "", text or "")])))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    assert {x.conv_id: bytes(x.path) for x in prefix_trie.turn_paths(df).collect()} == {c: b"".join(v) for c, v in own.items()}
    want = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        want[c] = b"".join(own.get(base, [])[:h] + v[h:])
    assert {x.conv_id: bytes(x.path) for x in prefix_trie.rebuilt(prefix_trie.turn_paths(df)).collect()} == want


def test_queries_give_what_their_sql_gives(spark):
    import duckdb

    from tests.conftest import SMALL
    from tests.test_catalog import table_of

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    for name in ("op11_repair", "op12_prefix_trie"):
        df = queries.queries()[name](spark, SMALL)
        cur = con.execute(queries.oracle_sql()[name])
        assert table_of(df.columns, df.collect()) == table_of([c[0] for c in cur.description], cur.fetchall())
