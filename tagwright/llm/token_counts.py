"""Token counts of fields and sections: a document is encoded once, and its tokens are attributed by their offsets.

A document is its fields, joined by line ends; its sections are the lines. The interval join puts each token into the
section that holds its first byte, so each token counts once, and a document's sections add up to its total;
``n_crossing`` counts the section's tokens that run on into a later section. Tokens and sections of a slice of documents
are sorted runs of numbers, joined at once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.bpe import KEPT_WORDS, WHITE, Chunks, arc_labels
from tagwright.llm.rans import PUNCTUATION

SLICE_CHARS = 4 << 20  # of text whose tokens a worker holds at a time
TOGETHER = 8000  # new words that the library sees at a time
OUTPUT = ["field", "section", "start_char", "end_char", "n_tokens", "n_crossing"]
SECTIONS = "array<struct<field:int,section:int,start_char:int,end_char:int,n_tokens:int,n_crossing:int>>"
TYPE = pa.struct([(n, pa.int32()) for n in OUTPUT])


class Library:
    """The tokenizers library in the place of an automaton."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer, model = Tokenizer.from_str(tokenizer_json), json.loads(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.length = np.array([len(x) for x in arc_labels(model)], np.int64)  # bytes of each token
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, text: str) -> list[int]:
        return self.encode_many([text])[0] if text else []


class LibraryChunks(Chunks):
    """Chunks whose new words the library encodes many at a time, without the punctuation at their ends: that is a word of its own."""

    def __init__(self, automaton: Library):
        super().__init__(automaton)
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def __missing__(self, chunk: str) -> bytes | None:
        packed = self[chunk] = self.old.get(chunk)  # what ``prepare`` has not learnt depends on its neighbours
        return packed

    def prepare(self, chunks: list[str]) -> None:
        if len(self) + len(chunks) >= 2 * KEPT_WORDS:  # generations change here alone, never while a slice is looked up
            self.old = dict(self)
            self.clear()
        special = tuple(self.automaton.special)
        known, old = self.get, self.old.get
        new = [c for c in chunks if known(c) is None and old(c) is None and (c[:1].isalnum() or c and not WHITE.match(c) and not c.startswith(special))]
        heads = [c.rstrip(PUNCTUATION) for c in new]
        heads = [h if len(h) < len(c) and h[-1:].isalpha() and "<|" not in c else c for c, h in zip(new, heads)]
        if len(self.heads) > 2 * KEPT_WORDS:
            self.heads.clear()
        self.learn(list(set(heads).difference(self.heads)))
        learnt, tails = self.heads, self.tails
        for c, h in zip(new, heads):
            t = c[len(h) :]
            if t not in tails:
                tails[t] = np.array(self.automaton.encode_pieces(t), np.int32).tobytes()
            self[c] = learnt[h] + tails[t]

    def learn(self, heads: list[str]) -> None:
        for k in range(0, len(heads), TOGETHER):
            part = heads[k : k + TOGETHER]
            # with a blank before each they are encoded alike in one text, and byte counts tell where each ends
            ids = np.array(self.automaton.encode_pieces(" " + " ".join(part)), np.int32)
            ends = np.searchsorted(np.cumsum(self.automaton.length[ids]), np.cumsum([len(c.encode()) + 1 for c in part])) + 1
            packed = ids.tobytes()
            for c, a, b in zip(part, [0, *(4 * ends[:-1]).tolist()], (4 * ends).tolist()):
                self.heads[c] = packed[a:b]


_library: dict[str, LibraryChunks] = {}


def spans(fields: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The whole document (fields joined by a line end) and, for each line, its field, first character and end.

    A line's end belongs to it, and so does the line end between two fields. An empty field is one empty section.
    """
    text, owner, ends = "\n".join(fields), [], []
    for k, f in enumerate(fields):
        *lines, rest = f.split("\n")
        sizes = [len(x) + 1 for x in lines] + [len(rest)] * (not lines or rest != "")
        sizes[-1] += k < len(fields) - 1
        owner += [k] * len(sizes)
        ends += sizes
    ends = np.cumsum(ends)
    starts = np.concatenate([[0], ends[:-1]])
    return text, np.array(owner, np.int32), starts, ends


def joined(chunks: LibraryChunks, documents: list[list[str | None]]) -> pa.Array:
    """SECTIONS of each document (a list of its fields): the interval join of all their tokens with all their sections."""
    cut = [spans([x or "" for x in fields]) for fields in documents]
    texts = pa.array([c[0] for c in cut], pa.string())
    raw = np.frombuffer("".join([c[0] for c in cut]).encode(), np.uint8)
    byte_of = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # of each character
    before = np.cumsum([0, *(len(c[0]) for c in cut)])
    rows = np.cumsum([0, *(len(c[1]) for c in cut)])
    owner, starts, ends = (np.concatenate([np.zeros(0, np.int64), *(c[k] for c in cut)]) for k in (1, 2, 3))
    shift = np.repeat(before[:-1], np.diff(rows))
    low, high = byte_of[starts + shift], byte_of[ends + shift]
    last = np.cumsum(chunks.automaton.length[chunks.encode(texts)[0]])
    first = np.concatenate([[0], last[:-1]])[: len(last)]
    at = np.searchsorted(low, first, "right") - 1  # of sections that start at one place all but the last are empty
    n = np.bincount(at, minlength=len(low))
    crossing = np.bincount(at[last > high[at]], minlength=len(low))
    first_of_field = np.concatenate([[True], (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1])])[: len(owner)]
    first_of_field[rows[:-1]] = True
    number = np.arange(len(owner)) - np.maximum.accumulate(np.where(first_of_field, np.arange(len(owner)), 0))
    columns = [pa.array(x.astype(np.int32)) for x in (owner, number, starts, ends, n, crossing)]
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(TYPE)))


def attribute(df: DataFrame, tokenizer_json: str, fields: list[str], keep: list[str]) -> DataFrame:
    """A row for each section (line) of each field of each row of ``df``: ``keep``, field, section, start_char, end_char, n_tokens, n_crossing.

    ``fields`` are text columns, joined by a line end and encoded as one document; offsets count characters of that. Null
    fields count as empty, and an empty field has one section, without tokens but for the line end behind it. Repeated rows
    count each; an empty table gives no rows. A name in ``keep`` that is also an output column is an error.
    """
    if not fields or set(keep) & set(OUTPUT):
        raise ValueError(f"no fields, or one of {OUTPUT} to be kept")
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.arrow_udf(SECTIONS)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if model.value not in _library:
            _library[model.value] = LibraryChunks(Library(model.value))
        chunks = _library[model.value]
        for batch in batches:
            held, size, out = [], 0, []
            for document in batch:
                held.append(document.as_py())
                size += sum(len(x or "") for x in held[-1])
                if size > SLICE_CHARS:
                    out.append(joined(chunks, held))
                    held, size = [], 0
            if held or not out:
                out.append(joined(chunks, held))
            yield pa.concat_arrays(out)

    counted = df.select(*[F.col(f"`{c}`") for c in keep], count(F.array(*[F.col(f"`{f}`") for f in fields])).alias("n_crossing"))
    names = F.array(*[F.lit(f) for f in fields])
    one = counted.select(*[F.col(f"`{c}`") for c in keep], F.explode_outer("n_crossing").alias("n_crossing"))  # never empty; a plain explode would infer a filter and count twice
    return one.select(*[F.col(f"`{c}`") for c in keep], F.get(names, F.col("n_crossing.field")).alias("field"), *[f"n_crossing.{c}" for c in OUTPUT[1:]])
