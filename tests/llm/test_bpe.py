import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tagwright.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_edge_texts_match_the_library(library):
    chunks, r = bpe.compiled(open(PATH, encoding="utf-8").read()), random.Random(1)
    texts = ["", " ", "a", "aaaaaaaaaaa  b", "foo\n bar", "foo\n\n  bar", "a<|endoftext|>b", "x\n <|endoftext|>", "\x1c a", "don't  we'll", "日本語 テスト 12345", "x" * 3000, "é" * 500, "👍🏽 ok", "ab" * 4000]
    texts += ["".join(r.choice("ab \n\t'ste.!1é日́<|endoftext|>") for _ in range(r.randint(1, 60))) for _ in range(500)]
    flat, n = chunks.encode(pa.array([*texts, None]))
    assert n[-1] == 0
    for text, ids in zip(texts, (x.tolist() for x in np.split(flat, np.cumsum(n[:-2]))), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert chunks.automaton.decode(ids) == text


def test_query_matches_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op1_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    words = open(PATH, encoding="utf-8").read()
    df = spark.createDataFrame([(1, None, "k"), (1, "a b", "k"), (1, "a b", "k"), (None, "", None)], "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(df, words), words).collect()
    assert sorted(map(str, (r.token_ids for r in out))) == sorted(map(str, [[], [64, 275], [64, 275], []]))
    assert [r.decoded for r in out].count("a b") == 2
    assert bpe.decode(bpe.encode(df.where("false"), words), words).count() == 0
