"""Byte-level BPE as a deterministic automaton: encoding and decoding of whole texts.

The automaton reads tokens. It starts with one token for each byte and every transition live; each merge (u, v) -> w, in
rank order, is one *gadget*: a new state w gets the transitions out of v and the transitions into u as they are at that
moment, and then the transition u -> v is cut. A token sequence is the BPE encoding of its bytes exactly if the finished
automaton accepts it. A gadget is recorded by its two parents, its rank and its cut, so compiling takes one step a merge;
a transition is read by walking up the gadgets once and is then kept in a table.

The accepting run is unique, and each of its prefixes is the encoding of the bytes so far: a place where a run got stuck
lies on no accepting run, so a search that marks such places takes a number of steps in proportion to the word.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.shared import in_a_row, pieces

# The word pattern of byte-level vocabularies, white space as Unicode has it.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
WHITE = regex.compile(r"\p{White_Space}")

KEPT_WORDS = 150_000  # encoded words that a worker keeps in each of two generations
KEPT_TRANSITIONS = 250_000
LONGEST_ARC = 1024  # bytes; no vocabulary in use has a longer token, and compiling refuses one


def byte_letters() -> dict[str, int]:
    """Letter of a vocabulary file -> byte: visible Latin-1 characters stand for themselves, the others follow from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


def arc_labels(model: dict) -> list[bytes]:
    """The bytes on each token's arc, by id."""
    letters, vocab = byte_letters(), model["model"]["vocab"]
    spell = [b""] * (max([*vocab.values(), *(x["id"] for x in model["added_tokens"])]) + 1)
    for text, i in vocab.items():
        spell[i] = bytes(letters[c] for c in text)
    for x in model["added_tokens"]:
        spell[x["id"]] = x["content"].encode()
    return spell


class MergeAutomaton:
    """Compiled merges. ``spell[id]``: the bytes on a token's arc."""

    def __init__(self, tokenizer_json: str):
        model = json.loads(tokenizer_json)
        self.spell, vocab = arc_labels(model), model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.between = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        size = len(self.spell)
        self.rank, self.into, self.out = [-1] * size, [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}
        for r, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(r, vocab[left], vocab[right], vocab[left + right])
        self._index([i for i in vocab.values() if i not in self.special.values()])
        self._live: dict[int, bool] = {}

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.rank[w], self.into[w], self.out[w] = rank, u, v
        self.cut[u << 20 | v] = rank

    def _index(self, ids: list[int]) -> None:
        """Arcs by their bytes: nested tables, a token's id under the key -1."""
        self.arcs: dict = {}
        for i in ids:
            node = self.arcs
            for b in self.spell[i]:
                node = node.setdefault(b, {})
            node[-1] = i
            if len(self.spell[i]) > LONGEST_ARC:
                raise ValueError("token too long")

    def live(self, a: int, b: int) -> bool:
        """Whether the state after token a has a transition on token b."""
        key = a << 20 | b
        known = self._live.get(key)
        if known is None:
            known = self._live[key] = self._walk(a, b)
            if len(self._live) > KEPT_TRANSITIONS:
                self._live.clear()
        return known

    def _walk(self, a: int, b: int) -> bool:
        before = 1 << 30  # only cuts made before the copied gadget count
        while True:
            cut = self.cut.get(a << 20 | b)
            if cut is not None and cut < before:
                return False
            new_a, new_b = self.rank[a], self.rank[b]
            if new_a < 0 and new_b < 0:
                return True
            if new_a > new_b:  # state a copied the transitions out of its right part
                before, a = new_a, self.out[a]
            elif new_b > new_a:  # token b came with the transitions into its left part
                if self.into[b] == self.out[b] == a:
                    return False  # of three equal tokens the first two merge
                before, b = new_b, self.into[b]
            else:
                before, a, b = new_a, self.out[a], self.into[b]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids on the accepting run over ``word``: the longest live arc first, a shorter one after a dead end.

        What leads to a place is that prefix's only encoding, so a place that proved dead is never tried again.
        """
        n, arcs, table = len(word), self.arcs, self._live
        out: list[int] = []
        places, dead, at, state = [0], None, 0, -1
        while at < n:
            node, found = arcs, []
            for b in word[at : at + LONGEST_ARC]:
                node = node.get(b)
                if node is None:
                    break
                found.append(node)
            end = at + len(found)
            for node in reversed(found):
                t = node.get(-1)
                if t is not None and not (dead and dead[end]):
                    if state < 0:
                        break
                    ok = table.get(state << 20 | t)
                    if self.live(state, t) if ok is None else ok:
                        break
                end -= 1
            else:
                dead = dead or bytearray(n + 1)
                dead[at] = 1
                out.pop()
                places.pop()
                at, state = places[-1], out[-1] if out else -1
                continue
            out.append(t)
            places.append(end)
            at, state = end, t
        return out

    def encode_pieces(self, text: str) -> list[int]:
        """Of any text: strings of special tokens first, then the words of what lies between them."""
        if text[1:].isalpha() and text[0] == " ":
            return self.encode_word(text.encode())
        out: list[int] = []
        for k, part in enumerate(self.between.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.special[part])
            else:
                for w in WORDS.findall(part):
                    out += self.encode_word(w.encode())
        return out

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_pieces(t) for t in texts]

    def decode(self, ids) -> str:
        return emit(self.spell, ids)


def emit(spell: list[bytes], ids) -> str:
    return b"".join([spell[i] for i in ids]).decode("utf-8", "replace")


class Chunks(dict):
    """Chunk between blanks -> its ids as packed 32-bit integers, or None where its words depend on its neighbours.

    With a blank before it, a chunk that starts with no white space and no special token is cut into words alike in any
    text. Two generations bound the memory.
    """

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton, self.old = automaton, {}

    def __missing__(self, chunk: str):
        if chunk in self.old:
            packed = self.old[chunk]
        elif not chunk or WHITE.match(chunk) or any(map(chunk.startswith, self.automaton.special)):
            packed = None
        else:
            packed = array("i", self.automaton.encode_pieces(" " + chunk)).tobytes()
        if len(self) >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        if len(chunk) < 200:
            self[chunk] = packed
        return packed

    def forget(self) -> None:
        """At a task's end: a worker that waits, or that other stages use, holds the compiled merges alone."""
        self.clear()
        self.old = {}
        self.automaton._live.clear()

    def prepare(self, chunks: list[str]) -> None:
        """Called with all chunks that are looked up next; an encoder that is better at many words at once learns them here."""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many ids each text has. Each different chunk of ``texts`` is looked up once."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        words = lists.flatten().dictionary_encode()
        known, at = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        self.prepare(known)
        packed = list(map(self.__getitem__, known))
        whole = np.array([p is None for p in packed] + [False])[at]  # chunks that depend on their neighbours
        whole[cuts[:-1]] = False
        starts, used = cuts[:-1].tolist(), np.ones(len(at), bool)
        alone = np.add.reduceat(whole, cuts[:-1]) > 0 if len(starts) else np.zeros(0, bool)
        for row in np.flatnonzero(alone).tolist():
            used[starts[row] + 1 : cuts[row + 1]] = False
        parts = [texts[row].as_py() if single else known[at[a]] for row, (a, single) in enumerate(zip(starts, alone.tolist()))]
        at[cuts[:-1]] = len(packed) + np.arange(len(parts))
        packed += [array("i", ids).tobytes() for ids in self.automaton.encode_many(parts)]
        size = np.array([len(p) if p else 0 for p in packed], np.int64) // 4
        ids, n = in_a_row(np.frombuffer(b"".join([p or b"" for p in packed]), np.int32), size, at[used])
        ends = np.zeros(len(at) + 1, np.int64)
        ends[1:][used] = n
        return ids, np.diff(np.cumsum(ends)[cuts])


_compiled: dict[str, Chunks] = {}
_labels: dict[str, list[bytes]] = {}


def compiled(tokenizer_json: str) -> Chunks:
    """One automaton a worker and vocabulary."""
    if tokenizer_json not in _compiled:
        _compiled[tokenizer_json] = Chunks(MergeAutomaton(tokenizer_json))
    return _compiled[tokenizer_json]


def token_lists(chunks: Chunks, texts: pa.Array) -> pa.Array:
    ids, n = chunks.encode(texts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))


def encode(df: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with the token ids of the whole ``text`` as ``ids`` array<int>.

    A null or empty text has no ids; a column named ``ids`` is replaced; other columns, repeated rows and empty tables
    pass as they are. Strings of special tokens in a text become their ids. The file's content is broadcast: a
    vocabulary is of bounded size.
    """
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.arrow_udf("array<int>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chunks = compiled(model.value)
        for texts in batches:
            for piece in pieces(texts):
                yield token_lists(chunks, piece)

    return df.withColumn(ids, tokens(F.col(f"`{text}`")))


def texts_of(spell: list[bytes], lists: pa.Array) -> pa.Array:
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
    return pa.array((emit(spell, flat[a:b].tolist()) for a, b in zip(ends, ends[1:])), pa.string())


def decode(df: DataFrame, tokenizer_json: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text whose tokens are ``ids``: the arcs' labels in turn, bytes that are no UTF-8 as U+FFFD. Null ids: empty."""
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if model.value not in _labels:
            _labels[model.value] = arc_labels(json.loads(model.value))
        spell = _labels[model.value]
        for batch in batches:
            for lists in pieces(batch):
                yield texts_of(spell, lists)

    return df.withColumn(text, texts(F.col(f"`{ids}`")))


def encode_and_decode(df: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))``, both by one worker: a task that calls them in turn has two, each with tables of its own."""
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chunks = compiled(model.value)
        for texts in batches:
            for piece in pieces(texts):
                lists = token_lists(chunks, piece)
                yield pa.StructArray.from_arrays([lists, texts_of(chunks.automaton.spell, lists)], ["ids", "decoded"])
        chunks.forget()

    return df.withColumn("_coded", coded(F.col(f"`{text}`"))).withColumns({ids: F.col("_coded.ids"), decoded: F.col("_coded.decoded")}).drop("_coded")
