import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tagwright.llm import queries, rans

SMALL = "/root/testdata/sf0.001"


def test_coder_round_trip_and_checkpoints():
    r = np.random.default_rng(3)
    for n in (1, 5, 1023, 1024, 1025, 300_000):
        ids = np.minimum(r.geometric(0.01, n), 40_000).astype(np.uint32)
        table = rans.quantised(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)))))
        assert sum(table.values()) == 1 << rans.PRECISION and min(table.values()) >= 1
        coder = rans.Coder(table)
        block = rans.Block(coder, rans.pack_block(coder, [(7, ids.tobytes())]))
        assert (block.ids() == ids).all()
        assert (np.concatenate([block.segment(k) for k in range(len(block.marks) + 1)]) == ids).all()


def test_quantised_extremes():
    for counts in ({1: 1}, {k: 1 for k in range(49_408)}, {0: 10**12, 1: 1, 2: 1}, {k: 10 ** (k % 7) for k in range(1000)}):
        table = rans.quantised(counts)
        assert sum(table.values()) == 1 << rans.PRECISION and min(table.values()) >= 1 and table.keys() == counts.keys()
    assert rans.quantised({}) == {}


def test_damage_is_found():
    coder = rans.Coder(rans.quantised({1: 3, 2: 5}))
    payload = bytearray(rans.pack_block(coder, [(1, np.array([1, 2, 2, 1], "<u4").tobytes())]))
    payload[-1] ^= 1
    with pytest.raises(ValueError):
        rans.Block(coder, bytes(payload))


def expected(rows, tokenizer):
    out, start = {}, 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_query_matches_the_library(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_rans(spark, SMALL).collect()}
    assert got == expected(rows, tokenizer)


def test_words_with_marks_at_their_ends():
    library, chunks, r = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), rans.LibraryChunks(queries.vocabulary("word_bpe_49k.json")), random.Random(6)
    texts = ["İ.", "İ)", "İ_", "İ-", "É.", "H\u0331.", "ﬀ!", "ß?", "Σ.", "aΣ. b", "ǅ,", "<|x.", "don't.", "'s.", "a.b.", "...", "日本。.", "1.", "a1.", "a\u0301.", ""]
    texts += ["".join(r.choice("aB é́İ\n\t1.'s!)_-日　Σß\u0331") for _ in range(r.randint(0, 30))) for _ in range(4000)]
    got = chunks.encode(pa.array([*texts, None]), 1).to_pylist()
    for t, x in zip([*texts, ""], got, strict=True):
        assert np.frombuffer(x, chunks.kind).tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_odd_texts(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(5)
    rows = [(1, None), (2, ""), (3, "A<|endoftext|>b <|startoftext|>"), (4, "é ́x  İstanbul\x1cfoo bar\tbaz\n\n1234"), (5, "ab " * 100_000)]
    rows += [(k, "".join(r.choice("aB é́ \n\t1.'s!日　") for _ in range(50))) for k in range(6, 200)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, ids string").repartition(5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.round_trip(df, queries.vocabulary("word_bpe_49k.json"), 1).selectExpr("*", "crc32(ids) ids_crc32").collect()}
    assert got == expected(rows, tokenizer)
    assert rans.round_trip(df.where("false"), queries.vocabulary("word_bpe_49k.json"), 1).count() == 0


def test_latin_words_go_to_the_model_alone():
    """A word of Latin letters is one piece: the library's whole way, of which the new words were most of the cost, is not taken."""
    library, chunks, r = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), rans.LibraryChunks(queries.vocabulary("word_bpe_49k.json")), random.Random(7)
    letters = [c for c in map(chr, range(0x180)) if c.isalpha() and c not in "ªµºİ"]
    words = [*letters, *("".join(r.choice(letters) for _ in range(r.randint(2, 14))) for _ in range(3000))]
    chunks.encode(pa.array(["x."]), 1)  # the full stop is no word
    chunks._ids = None
    got = chunks.encode(pa.array([" ".join(words), *(w + ". " + w for w in words)]), 1).to_pylist()
    for t, x in zip([" ".join(words), *(w + ". " + w for w in words)], got, strict=True):
        assert np.frombuffer(x, chunks.kind).tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], repr(t)
