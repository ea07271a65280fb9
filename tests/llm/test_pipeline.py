"""The five stages of the corpus pipeline, each against a plain version, on a small table with odd rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
import public_tokenizers
from tagwright.llm import bpe, decontaminate, quality, simhash, toxicity
from tagwright.llm.shared import ARROW_BYTES, small_batches, staged

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, "en", None, None), (90_002, "", None, "s", 0), (90_003, "", "en", "s", 0), (None, "no id", "en", "s", 5), (90_004, "word " * 30_000, "en", "s", 150_000), (90_005, "Same text twice here now.", "en", "s", 1), (90_005, "Same text twice here now.", "en", "s", 1)], rows.schema)
    return staged(rows.select(*COLUMNS).union(odd), "docs")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_quality_keeps_what_is_within_the_limit(spark, docs):
    kept = pipeline.quality_filter(spark, docs, SMALL)
    assert kept.columns == COLUMNS
    scored = quality.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert ids(kept) == sorted((r.doc_id for r in scored if r.perplexity <= r.threshold), key=str)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in set(ids(kept)) for d in good) >= 0.95 * len(good)


def test_toxicity_keeps_what_scores_below(spark, docs):
    kept = pipeline.toxicity_filter(spark, docs, SMALL)
    assert kept.columns == COLUMNS
    words = toxicity.Words(toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert ids(kept) == sorted((r.doc_id for r in docs.collect() if words.score(r.text) < pipeline.TOXIC), key=str)


def test_one_near_duplicate_of_each_class_stays(spark, docs):
    kept = pipeline.near_duplicate_filter(spark, docs, SMALL)
    assert kept.columns == COLUMNS
    sets = [(r.doc_id, frozenset(simhash.shingles(r.text, 5))) for r in docs.collect()]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    parent = {d: d for d, _ in sets if d is not None}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, a in sets:
        for e, b in sets:
            if d is not None and e is not None and d < e and alike(a, b):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    want = {d for d in parent if find(d) == d}
    got = [d for d in ids(kept) if d is not None]
    assert len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) <= 1  # no clean one is lost; recall is not quite 1
    assert ids(kept).count(None) == 1


def test_documents_with_an_item_go(spark, docs):
    kept = pipeline.decontamination_filter(spark, docs, SMALL)
    assert kept.columns == COLUMNS
    bench = decontaminate.Benchmark.of([(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    hit = set()
    for r in docs.collect():
        x = bench.number_words(r.text)
        if any(len(x) and decontaminate.best_match(item, x)[0] <= decontaminate.allowed(len(item)) for item in bench.items if len(set(item.tolist()) & set(x.tolist())) > len(set(item.tolist())) // 2):
            hit.add(r.doc_id)
    assert ids(kept) == sorted((r.doc_id for r in docs.collect() if r.doc_id not in hit), key=str)


def test_bpe_stage_and_whole_run(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = pipeline.run(spark, SMALL).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert out and {r.doc_id for r in out} <= rows.keys()
    for r in out:
        assert r.token_ids == library.encode(rows[r.doc_id], add_special_tokens=False).ids and r.text == rows[r.doc_id] and r.n_tokens == len(r.token_ids)
    assert [name for name, _ in pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "bpe"]


def test_empty_documents_pass_all_stages(spark, docs):
    none = docs.where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_a_task_of_the_bpe_stage_has_one_worker(spark, docs):
    out = pipeline.token_ids(spark, docs, SMALL)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    words = pipeline.vocabulary("byte_bpe_50k.json")
    apart = bpe.decode(bpe.encode(docs.select("doc_id", "text"), words), words)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(out.select("doc_id", "token_ids", "text")) == rows(apart.select("doc_id", "token_ids", "decoded"))
    clash = docs.select("doc_id", F.lit("x").alias("token_ids"), F.lit(1).alias("decoded"), "text")
    assert rows(bpe.encode_and_decode(clash, words).select("doc_id", "token_ids", "decoded")) == rows(apart.select("doc_id", "token_ids", "decoded"))


def test_stages_send_small_batches(spark, docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    large = spark.range(60, numPartitions=1).select(F.repeat(F.lit("0123456789"), 50_000).alias("text"))
    before = spark.conf.get(ARROW_BYTES, None)
    try:
        spark.conf.unset(ARROW_BYTES)
        pipeline.token_ids(spark, docs, SMALL)
        found = [r.n for r in large.mapInArrow(sizes, "n long").collect()]
        assert sum(found) >= 30_000_000 and max(found) < 6_000_000
        assert all(pipeline.in_small_batches(stage.__wrapped__).__code__ is stage.__code__ for _, stage in pipeline.STAGES)
        spark.conf.set(ARROW_BYTES, "1m")
        small_batches(spark)
        assert spark.conf.get(ARROW_BYTES) == "1m"
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)
