"""The queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.llm import bpe, decontaminate, language, prefix_trie, quality, rans, repair, simhash, syncmers, token_counts, toxicity, url_rules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_and_decode(docs, words)
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = syncmers.compare_with_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


URL_RULES = [
    url_rules.Rule("block", "com", "/en/"),
    url_rules.Rule("allow", "example.com", "/en/7"),
    url_rules.Rule("allow", "net", "/de/"),
    url_rules.Rule("block", "example.net", "/de/8"),
    url_rules.Rule("block", "org", "/es/"),
]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, bits=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = found.select("doc_id", F.explode_outer("hits").alias("hit")).where("hit IS NOT NULL")  # a plain explode would infer a filter and find twice
    return hits.select("doc_id", "hit.item_id", "hit.edits", "hit.start_word", "hit.n_words")


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rans.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), ["source", "text"], ["doc_id"])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"), keep_text=False)
    return out.select("doc_id", "lang", "perplexity", "threshold", "keep")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), "copies")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", repair.digest().alias("repaired_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_paths(table(spark, sf_dir, "conversations"))))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII text in DuckDB: a fold over its bytes, a bit at a time; 3988292384 is the polynomial."""
    bits = ", ".join(["3988292384::UBIGINT"] * 8)
    return (
        f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::UBIGINT)), "
        f"lambda c, b: list_reduce(list_prepend(xor(c, b), [{bits}]), lambda x, p: xor(x >> 1, p * (x & 1)))))"
    )


def _state(of: str, cost: str, mark: str, when: str = "true") -> str:
    return f"CASE WHEN {of} IS NOT NULL AND {when} THEN {{'cost': {of}.cost + {cost}, 'audit': {of}.audit || '{mark}'}} END"


def _op11_sql() -> str:
    stays = "fault NOT IN ('blank', 'duplicate')"
    step = {
        "n": [_state("n", "4", "D")],
        "s": [_state("s", "4", "D"), _state("n", "extra", "K", f"{stays} AND initial = 's'")],
        "u": [_state("u", "4", "D"), *[_state(x, "extra", "K", f"{stays} AND initial = 'u'") for x in "nsa"], *[_state(x, "extra + 3", "R", stays) for x in "nsa"]],
        "a": [_state("a", "4", "D"), _state("u", "extra", "K", f"{stays} AND initial = 'a'"), _state("u", "extra + 3", "R", stays)],
    }
    least = ", ".join(f"least({', '.join([*c, c[0]])}) AS {k}" for k, c in step.items())
    insert = ", ".join(["n", "s", f"least(u, {', '.join(_state(k, '3', 'I') for k in 'nsa')}) AS u", f"least(a, {_state('u', '3', 'I')}, {', '.join(_state(k, '6', 'II') for k in 'ns')}) AS a"])
    return f"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc32_sql('k')} % 20 AS kind FROM keyed),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
placed AS (
  SELECT *, role[1:1] AS initial, row_number() OVER o AS place, lag(role[1:1]) OVER o AS before,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS stripped
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faulty AS (
  SELECT *, CASE WHEN stripped = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                 WHEN stripped[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
costly AS (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END::BIGINT AS extra FROM faulty),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS n_rows,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM costly GROUP BY conv_id),
folded AS (
  SELECT conv_id, 0::BIGINT AS place, {{'cost': 0::BIGINT, 'audit': ''}} AS n, NULL::STRUCT(cost BIGINT, audit VARCHAR) AS s,
         {{'cost': 3::BIGINT, 'audit': 'I'}} AS u, {{'cost': 6::BIGINT, 'audit': 'II'}} AS a
  FROM counts
  UNION ALL
  SELECT conv_id, place, {insert}
  FROM (SELECT f.conv_id, c.place, {least} FROM folded f JOIN costly c ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND c.place = f.place + 1)),
best AS (SELECT f.conv_id, least(f.n, f.a) AS b FROM folded f JOIN counts c ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.place = c.n_rows),
letters AS (SELECT conv_id, unnest(range(1, length(b.audit) + 1)) AS pos, substr(b.audit, unnest(range(1, length(b.audit) + 1)), 1) AS edit FROM best),
counted AS (
  SELECT *, sum((edit <> 'I')::INT) OVER w AS place, sum((edit <> 'D')::INT) OVER w AS out
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
led AS (
  SELECT l.*, c.role, c.text, max((edit = 'K' AND out = 1 AND c.initial = 's')::INT) OVER (PARTITION BY l.conv_id) AS system
  FROM counted l LEFT JOIN costly c ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.place = c.place AND l.edit <> 'I'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - 1 - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS repaired
  FROM led WHERE edit <> 'D' GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON i.conv_id IS NOT DISTINCT FROM best.conv_id
LEFT JOIN texts t ON i.conv_id IS NOT DISTINCT FROM t.conv_id
"""


OP12_SQL = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT conv_id, turn, sha256(length(role)::VARCHAR || ':' || role || text)[1:32] AS k, strlen(text) AS b FROM rows),
own AS (SELECT conv_id, list({{'k': k, 'b': b}} ORDER BY turn NULLS FIRST, k, b) AS turns FROM named GROUP BY conv_id),
headed AS (SELECT *, conv_id::VARCHAR AS c FROM own),
heads AS (SELECT conv_id, turns, ({crc32_sql('c')} % 9)::BIGINT AS h FROM headed),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(o.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own o ON o.conv_id = a.conv_id - a.conv_id % 5),
members AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(turns)), '')) AS ends_sha256
  FROM members GROUP BY 1, 2),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own_parts AS (SELECT n.node, n.depth, (c.n IS NULL)::INT AS leaf, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * n.node[n.depth].b ELSE 0 END AS saved FROM nodes n LEFT JOIN children c ON n.node = c.node),
above AS (SELECT node, leaf, saved, unnest(range(0, depth + 1)) AS d FROM own_parts),
subtrees AS (SELECT node[1:d] AS node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
LEFT JOIN children c ON n.node = c.node JOIN subtrees s ON n.node = s.node
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_syncmers": op2_syncmers,
    "op3_url_rules": op3_url_rules,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_rans": op6_rans,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_repair": op11_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language": op13_language,
}

SQL: dict[str, str] = {"op10_warc": OP10_SQL, "op11_repair": _op11_sql(), "op12_prefix_trie": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
