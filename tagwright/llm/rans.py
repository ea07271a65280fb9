"""Token ids as compressed block files: static range asymmetric numeral system (rANS) with shared frequencies.

A store is a folder with two Parquet tables that Spark commits as a whole:

* ``frequencies`` (id int, frequency int): quantised to a sum of 2**20 over every id that occurs, counted over all documents;
* ``blocks`` (part int, block int, part_offset long, n_docs long, n_ids long, payload binary): whole documents in ascending
  id order; ``part_offset`` counts the ids of the part's blocks before this one.

A payload is independent of all others: header, document table, checkpoints, lane states, 32-bit words. Identifiers are
dealt to interleaved lanes (identifier k to lane k mod lanes), so a numpy step codes one identifier of every lane. At
every ``CHECK_STEPS`` steps the lanes' states and the place in the words are kept: decoding may start at any of these
checkpoints. The header has the CRC-32 of the identifiers and of the rest of the payload; a reader raises on a mismatch.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwright.llm.bpe import byte_letters
from tagwright.llm.shared import in_a_row, pieces, shared_dir, staged

PRECISION = 20
LOWEST = np.uint64(1 << 31)
LANES = 1024
CHECK_STEPS = 128
BLOCK_IDS = 1 << 18
MAGIC = b"TWR1"
HEAD = struct.Struct("<4sIQIIIII")  # magic, lanes, ids, documents, checkpoints, words, CRC of ids, CRC of what follows
KEPT_HEADS = 600_000
TOGETHER = 2000  # heads that the library sees at a time
MARK = "\x01"
# one piece to the vocabulary, however it is normalised: no letter here is composed, taken apart or changed but for its case
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+")
BLOCKS = "part int, block int, part_offset long, n_docs long, n_ids long, payload binary"
BLOCK_NAMES = ["part", "block", "part_offset", "n_docs", "n_ids", "payload"]
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<|>")
PIECE_BYTES = 8 << 20  # of text whose words are looked up together
BYTE_LEVEL = {b: c for c, b in byte_letters().items()}  # of a byte's number the letter that the vocabulary has for it


class LibraryChunks:
    """Chunk between blanks -> packed ids, by the tokenizers library.

    The vocabulary drops white space and never joins words across it, or a word and ASCII punctuation other than an
    apostrophe: a text's ids are its chunks' in turn, a chunk's those of its head and of the punctuation at its end. So the
    library sees each new head once, in lower case (as its normaliser has it). A head of Latin letters is one piece, which its
    model takes as it is; others it sees many at a time between marks of one token.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.heads: dict[str, bytes] = {"": b""}
        self.kind = id_type(tokenizer_json)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.model = self.tokenizer.model
        self.latin = all(self._direct([c]) == [np.array(self._ids(c), self.kind).tobytes()] for c in (*filter(LATIN.match, map(chr, range(0x180))), "aZ", "Éñ"))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _direct(self, heads: list[str]) -> list[bytes]:
        """Packed ids of heads of Latin letters."""
        of_word, ids, ends = self.model.tokenize, [], [0]
        for h in map(str.lower, heads):
            ids += [t.id for t in of_word(h if h.isascii() else h.encode().decode("latin-1").translate(BYTE_LEVEL))]
            ends.append(len(ids))
        packed, size = np.array(ids, self.kind).tobytes(), np.dtype(self.kind).itemsize
        return [packed[size * a : size * b] for a, b in zip(ends, ends[1:])]

    def _learn(self, heads: list[str]) -> None:
        plain, heads_of, size = [], self.heads, np.dtype(self.kind).itemsize
        if self.latin:
            one_piece = list(filter(LATIN.fullmatch, heads))
            heads_of.update(zip(one_piece, self._direct(one_piece)))
            heads = [h for h in heads if h not in heads_of]
        for h in heads:
            if self.mark is None or MARK in h or "<|" in h:
                heads_of[h] = np.array(self._ids(h), self.kind).tobytes()
            else:
                plain.append(h)
        for k in range(0, len(plain), TOGETHER):
            part = plain[k : k + TOGETHER]
            ids = np.array(self._ids(f" {MARK} ".join([*part, ""])), self.kind)
            ends = size * np.flatnonzero(ids == self.mark)
            packed = ids.tobytes()
            for h, at, end in zip(part, [0, *(ends + size).tolist()], ends.tolist(), strict=False):
                heads_of[h] = packed[at:end]
            if len(ends) != len(part):
                raise ValueError("a mark is missing")

    def _packed(self, heads: list[str]) -> list[bytes]:
        known = self.heads
        self._learn(list(set(heads).difference(known)))
        out = list(map(known.__getitem__, heads))
        if len(known) > KEPT_HEADS:
            self.heads = {"": b""} | (dict(zip(heads, out)) if len(heads) < KEPT_HEADS // 4 else {})
        return out

    def encode(self, texts: pa.Array, end: int) -> pa.Array:
        """Packed ids of each text, then ``end``. Each different head is looked up once; numpy puts the words' ids in a row."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words, per = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy()
        heads, tails = (x.dictionary_encode() for x in cut(words.dictionary))
        packed = [*self._packed(heads.dictionary.to_pylist()), *self._packed(tails.dictionary.to_pylist()), np.array([end], self.kind).tobytes(), b""]
        parts = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + len(heads.dictionary)], axis=1).ravel()
        ids, n = in_a_row(np.frombuffer(b"".join(packed), self.kind), np.array(list(map(len, packed))) // np.dtype(self.kind).itemsize, np.append(parts, [len(packed) - 2, len(packed) - 1]))
        # the end, the last of the words now, stands behind each text's
        ids, n = in_a_row(ids, n.reshape(-1, 2).sum(axis=1), np.insert(words.indices.to_numpy(), np.cumsum(per), len(words.dictionary)))
        cuts = np.dtype(self.kind).itemsize * np.append(0, np.append(0, np.cumsum(n))[np.cumsum(per + 1)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])


def cut(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word's head and the punctuation at its end, where the head ends in a letter; else the word and nothing.

    The head has to end in a letter after lower-casing, too: a mark at its end would join the punctuation.
    """
    heads = pc.utf8_rtrim(words, PUNCTUATION)
    whole, size = pc.binary_length(words).to_numpy(), pc.binary_length(heads).to_numpy()
    ends = np.frombuffer(heads.buffers()[1], np.int32)[heads.offset + 1 :][: len(heads)]
    data = np.frombuffer(heads.buffers()[2] or b"", np.uint8)
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)], 0) if len(data) else np.zeros(len(heads), np.uint8)
    apart = ((last | 32) >= 97) & ((last | 32) <= 122) & (last < 128)
    wide = np.flatnonzero(last >= 128)
    apart[wide] = [h[-1].lower()[-1].isalpha() for h in heads.take(pa.array(wide)).to_pylist()]
    apart &= (whole > size) & ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(apart)
    tails = np.full(len(words), "", object)
    tails[rows] = [w[-n:] for w, n in zip(words.take(pa.array(rows)).to_pylist(), (whole - size)[rows].tolist())]
    heads = pc.if_else(pa.array(apart), heads, words)
    return pc.if_else(pc.string_is_ascii(heads), pc.ascii_lower(heads), heads), pa.array(tails, pa.string())


def id_type(tokenizer_json: str) -> str:
    """Two bytes for an id where all of a vocabulary's fit, else four."""
    model = json.loads(tokenizer_json)
    most = max([*model["model"]["vocab"].values(), *(x["id"] for x in model["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


_library: dict[str, LibraryChunks] = {}


def tokenize(df: DataFrame, tokenizer_json: str, end_id: int, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the whole text's ids and ``end_id`` after them, as integers of ``id_type`` in binary ``ids``. Null text: ``end_id`` alone."""
    if end_id >= 1 << 8 * np.dtype(id_type(tokenizer_json)).itemsize:
        raise ValueError("end_id is wider than the vocabulary's ids")
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if model.value not in _library:
            _library[model.value] = LibraryChunks(model.value)
        chunks = _library[model.value]
        for texts in batches:
            for piece in pieces(texts, PIECE_BYTES):
                yield chunks.encode(piece, end_id).cast(pa.binary())

    return df.withColumn(ids, packed(F.col(f"`{text}`")))


def quantised(counts: dict[int, int]) -> dict[int, int]:
    """Frequencies that sum to 2**PRECISION, one at least for every id that occurs; the most frequent ids take the rounding."""
    total, whole = sum(counts.values()), 1 << PRECISION
    if not total:
        return {}
    if len(counts) > whole:
        raise ValueError("more ids than slots")
    out = {i: max(1, n * whole // total) for i, n in counts.items()}
    over, order = sum(out.values()) - whole, sorted(out, key=lambda i: (-out[i], i))
    while over:
        for i in order:
            if not over:
                break
            give = max(-max(1, out[i] // 8), -out[i] + 1, min(-over, out[i])) if over > 0 else min(-over, max(1, out[i] // 8))
            if over > 0:
                give = -min(over, max(0, min(out[i] - 1, max(1, out[i] // 8))))
            out[i] += give
            over += give
    return out


class Coder:
    """rANS over one frequency table; states are 64-bit, words 32-bit."""

    def __init__(self, frequency: dict[int, int]):
        ids = np.array(sorted(frequency), np.int64)
        size = int(ids.max()) + 1 if len(ids) else 1
        self.f, self.base = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        f = np.array([frequency[int(i)] for i in ids], np.uint64)
        self.f[ids], self.base[ids] = f, np.cumsum(f) - f
        self.of_slot = np.repeat(ids, f.astype(np.int64)).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """States that decoding starts from, words, and (words before, states) of each checkpoint."""
        n, lanes = len(ids), min(LANES, max(1, len(ids)))
        steps = -(-n // lanes)
        f, base = self.f[ids], self.base[ids]
        if not f.all():
            raise ValueError("an id without a frequency")
        most = f << np.uint64(31 - PRECISION + 32)
        x = np.full(lanes, LOWEST, np.uint64)
        out, marks = [], {}
        for t in range(steps - 1, -1, -1):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            y, g = x[: b - a], f[a:b]
            full = y >= most[a:b]
            out.append((y[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            y = np.where(full, y >> np.uint64(32), y)
            q = y // g
            x[: b - a] = (q << np.uint64(PRECISION)) + (y - q * g) + base[a:b]
            if t and t % CHECK_STEPS == 0:
                marks[t] = x.copy()
        out.reverse()
        before = np.cumsum([0, *map(len, out)])
        words = np.concatenate(out) if out else np.zeros(0, np.uint32)
        return x, words, [(int(before[t]), marks[t]) for t in sorted(marks)]

    def decode(self, n: int, lanes: int, x: np.ndarray, words: np.ndarray, at: int = 0, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of the steps from ``start`` (whose states are ``x``, with ``at`` words read) up to ``stop``."""
        steps = -(-n // lanes)
        stop = steps if stop is None else min(stop, steps)
        out = np.empty(max(0, min(n, stop * lanes) - start * lanes), np.uint32)
        x, mask, shift = x.copy(), np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
        for t in range(start, stop):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            y = x[: b - a]
            slot = y & mask
            s = self.of_slot[slot]
            out[a - start * lanes : b - start * lanes] = s
            y = self.f[s] * (y >> shift) + slot - self.base[s]
            low = np.flatnonzero(y < LOWEST)
            y[low] = (y[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
            x[: b - a] = y
        return out


def pack_block(coder: Coder, docs: list[tuple[int | None, bytes]], kind: str = "<u4") -> bytes:
    ids, size = np.frombuffer(b"".join([d for _, d in docs]), kind), np.dtype(kind).itemsize
    x, words, marks = coder.encode(ids)
    body = b"".join(
        [
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
            np.array([d is None for d, _ in docs], np.uint8).tobytes(),
            np.array([len(r) // size for _, r in docs], "<u4").tobytes(),
            *(struct.pack("<Q", at) + states.astype("<u8").tobytes() for at, states in marks),
            x.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
        ]
    )
    return HEAD.pack(MAGIC, len(x), len(ids), len(docs), len(marks), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


class Block:
    """A payload, opened: documents at once, identifiers on demand, whole or from a checkpoint."""

    def __init__(self, coder: Coder, payload: bytes):
        magic, self.lanes, self.n, docs, marks, words, self.crc, crc = HEAD.unpack_from(payload)
        if magic != MAGIC or zlib.crc32(payload[HEAD.size :]) != crc:
            raise ValueError("damaged block")
        self.coder, at = coder, HEAD.size

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, k, at)
            at += got.nbytes
            return got

        self.doc_ids, self.no_id, self.lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.marks = [(int(take("<u8", 1)[0]), take("<u8", self.lanes)) for _ in range(marks)]
        self.states, self.words = take("<u8", self.lanes), take("<u4", words)

    def segment(self, k: int) -> np.ndarray:
        """Identifiers from checkpoint k (0: the start) to the next."""
        at, x = self.marks[k - 1] if k else (0, self.states)
        return self.coder.decode(self.n, self.lanes, x, self.words, at, k * CHECK_STEPS, (k + 1) * CHECK_STEPS)

    def ids(self) -> np.ndarray:
        out = self.coder.decode(self.n, self.lanes, self.states, self.words)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("damaged identifiers")
        return out


def write_store(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids", kind: str = "<u4") -> None:
    """Write the packed ids of ``df`` (numpy type ``kind``) to the folder ``path`` in ascending ``doc_id`` (null first; equal ids in no set order).

    ``df`` is read twice, for the frequencies and for the blocks: hand in a written table.
    """

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch.column(0), PIECE_BYTES):
                n = np.bincount(np.frombuffer(b"".join([x or b"" for x in part.to_pylist()]), kind))
                if len(n) > len(total):
                    total, n = n.astype(np.int64), total
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    spark = df.sparkSession
    counts = df.select(F.col(f"`{ids}`")).mapInArrow(histogram, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = quantised({r.id: r.n for r in counts.collect()})  # as many rows as the vocabulary has ids
    spark.createDataFrame(sorted(table.items()), "id int, frequency int").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(table)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, k, before, size = Coder(shared.value), TaskContext.get().partitionId(), 0, 0, np.dtype(kind).itemsize

        def row(docs, n):
            values = [[part], [k], [before], [len(docs)], [n], [pack_block(coder, docs, kind)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, BLOCK_TYPES)], BLOCK_NAMES)

        docs, n = [], 0
        for batch in batches:
            for d, x in zip(batch.column(0), batch.column(1)):
                docs.append((d.as_py(), x.as_py() or b""))
                n += len(docs[-1][1]) // size
                if n >= BLOCK_IDS:
                    yield row(docs, n)
                    docs, n, k, before = [], 0, k + 1, before + n
        if docs:
            yield row(docs, n)

    ordered = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{ids}`").alias("ids")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids (packed). Each block decodes by itself."""
    table = {r.id: r.frequency for r in spark.read.parquet(f"{path}/frequencies").collect()}
    shared = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each written partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for start, payload in zip(batch.column(0), batch.column(1)):
                block = Block(coder, payload.as_py())
                raw, ends = block.ids().astype("<u4").tobytes(), np.cumsum([0, *block.lengths.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.doc_ids, mask=block.no_id.astype(bool)),
                        pa.array(ends[:-1] + start.as_py(), pa.int64()),
                        pa.array(block.lengths.astype(np.int64)),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    placed = blocks.join(F.broadcast(before), "part").select((F.col("part_start") + F.col("part_offset")).alias("block_start"), "payload")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(df: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """Tokenize ``df`` (doc_id, text), write a store to the shared folder, and give what reading it back gives."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagwright/store-{uuid.uuid4().hex}"
    packed = staged(tokenize(df.select("doc_id", "text"), tokenizer_json, end_id).select("doc_id", "ids"), "ids")
    write_store(packed, path, kind=id_type(tokenizer_json))
    return read_store(spark, path)
