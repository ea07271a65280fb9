"""From raw documents to token ids, in five stages; each works on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet and reads them
again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.llm import bpe, decontaminate, quality, simhash, toxicity
from tagwright.llm.queries import table, vocabulary
from tagwright.llm.shared import small_batches, staged

TOXIC = 0.7
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The executors serve all stages of a session one after the other, so none may leave them large."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


@in_small_batches
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxicity") < TOXIC).select(*docs.columns)


@in_small_batches
def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five words, a similarity of 0.8."""
    return simhash.one_of_each(docs)


@in_small_batches
def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select(*docs.columns)


@in_small_batches
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and the text that they decode to."""
    words = vocabulary("byte_bpe_50k.json")
    coded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), words)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").alias("n_tokens"), "token_ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", decontamination_filter),
    ("bpe", token_ids),
]

ORACLE_SQL = None  # models, SimHash and BPE are not expressible in SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
