"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are rows of words. The CGK walk copies a row's word and then, by a random bit that depends on the step and the word,
moves on or copies it again; rows at a small edit distance so become rows at a small Hamming distance. Each of the LSH
tables samples ``SAMPLED`` of the walk's steps; a window of an item's length and an item that agree in all of one table's
steps are a candidate, and the edit distance of the item to the text around the window decides. A walk that an early edit
throws off may never meet the other one again, so there are ``WALKS`` walks by bits of their own, each with all its tables.

Only windows with enough of the benchmark's word pairs are walked: an edit breaks two pairs at most, so a window within
the distance has at least ``n - 1 - 2 * edits`` of them. That drops no window that the last step would accept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.shared import in_a_row, staged

SIMILARITY = 0.8  # 1 - edits / words of the item
SAMPLED = 2
AGREEMENT = 0.3  # share of a walk's steps that still agree at the largest distance, measured on random rows
RECALL = 0.97  # of one walk's tables
WALKS = 2
STEPS = 2  # steps of a walk for each word: on average it moves on at every other step
ASCII_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
TEXTS_AT_ONCE = 1500
AT_ONCE = 20_000  # windows walked at a time
NO_WORD = -2  # stands between texts
BLOCK_CHARS = 32 << 20  # of benchmark text held at a time
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
HITS = "array<struct<item_id:bigint,edits:int,start_word:int,n_words:int>>"
HIT = pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start_word", pa.int32()), ("n_words", pa.int32())])


def repetitions(agreement: float = AGREEMENT, sampled: int = SAMPLED, recall: float = RECALL) -> int:
    """Tables that find a pair with the given recall if each sampled step agrees with the given chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled))


def allowed(n: int) -> int:
    return int(n * (1 - SIMILARITY) + 1e-9)


def walk(row: np.ndarray, starts: np.ndarray, steps: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """CGK walk ``number`` from each of ``starts`` along ``row``: the word at each step, and how many words lie behind the walk.

    A step's bit depends on the step and the word alone, so one walk serves windows of every length: it ends for a window
    of n words where n words lie behind it.
    """
    at, words, behind = np.zeros(len(starts), np.int32), np.empty((steps, len(starts)), np.int32), np.empty((steps, len(starts)), np.int32)
    bits = np.random.default_rng(11 + number).integers(1, 1 << 62, steps, dtype=np.uint64) | np.uint64(1)
    place, last = starts.copy(), len(row) - 1
    for j in range(steps):
        word = row[np.minimum(place, last)]
        words[j], behind[j] = word, at
        move = ((word.astype(np.uint64) + np.uint64(2)) * bits[j] >> np.uint64(61)).astype(np.int32) & 1
        at += move
        place += move
    return words, behind


def table_keys(walked: tuple[np.ndarray, np.ndarray], of: np.ndarray, n: int, used_up: int, number: int) -> np.ndarray:
    """Keys of the windows ``of`` (columns of walk ``number``) in each table for rows of n words; ``used_up`` (negative) where a sampled step lies behind the row's end."""
    picks = np.random.default_rng((12, n, number)).integers(0, STEPS * n, (repetitions(), SAMPLED))
    words, behind = walked
    keys = np.zeros((len(picks), len(of)), np.int64)
    ended = np.zeros(keys.shape, bool)
    for k in range(SAMPLED):
        at = picks[:, k, None], of[None, :]
        picked = words[at]
        keys = keys << 24 | np.maximum(picked, 0)
        ended |= (behind[at] >= n) | (picked < 0)
    keys = keys << 10 | (np.arange(len(picks)) + number * len(picks))[:, None]
    keys[ended] = used_up
    return keys


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits of ``item`` to any run of ``text``, with that run's start and end (the first such end)."""
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    places = np.arange(m + 1)
    for k, w in enumerate(item, 1):
        step = np.empty(m + 1, np.int64)
        back = np.empty(m + 1, np.int64)
        step[0], back[0] = k, 0
        swap = cost[:-1] + (text != w)
        drop = cost[1:] + 1
        step[1:] = np.minimum(swap, drop)
        back[1:] = np.where(swap <= drop, start[:-1], start[1:])
        slack = step - places  # extra words of the text cost one each
        low = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == low, places, 0))
        cost, start = low + places, back[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


@dataclass
class Benchmark:
    """Items as rows of word numbers, and what finds them."""

    ids: list[int]
    items: list[np.ndarray]
    number: dict[str, int]
    pairs: np.ndarray = field(init=False)  # sorted
    own_pairs: list[np.ndarray] = field(init=False)  # each item's, sorted
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)  # length -> sorted keys, their items
    words: pa.Array = field(init=False)  # by number, from 1

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Benchmark:
        number: dict[str, int] = {}
        kept = [(i, [number.setdefault(w, len(number) + 1) for w in WORD.findall(t.lower())]) for i, t in rows]
        kept = [(i, x) for i, x in kept if x]
        return cls([i for i, _ in kept], [np.array(x, np.int64) for _, x in kept], number)

    def __post_init__(self):
        own = [np.unique(x[:-1] << 32 | x[1:]) for x in self.items]
        self.pairs, self.own_pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *own])), own
        self.tables, self.words = {}, pa.array(list(self.number), pa.string())
        row = np.concatenate([np.zeros(0, np.int64), *self.items])
        first = np.cumsum([0, *map(len, self.items)])[:-1]
        for n in {len(x) for x in self.items}:
            rows = np.array([k for k, x in enumerate(self.items) if len(x) == n])
            keys = np.concatenate([table_keys(walk(row, first[rows], STEPS * n, k), np.arange(len(rows)), n, -1, k) for k in range(WALKS)])
            order = np.argsort(keys.ravel(), kind="stable")
            self.tables[n] = keys.ravel()[order], np.tile(rows, len(keys))[order]

    def number_words(self, text: str | None) -> np.ndarray:
        """The text's words as numbers, 0 for words that no item has."""
        return self.numbers(pa.array([text], pa.string()))[0]

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' words as numbers in a row, and how many words each text has. Each different chunk is looked up once."""
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        cut = words.dictionary
        trimmed = pc.utf8_trim(pc.utf8_lower(cut), ASCII_MARKS)
        # a chunk of several words, and letters whose lower case is no single one, go to the pattern
        plain = pc.and_not(pc.utf8_is_alnum(trimmed), pc.match_substring_regex(cut, "[İΣ]")).to_numpy(zero_copy_only=False)
        number = pc.fill_null(pc.index_in(trimmed, value_set=self.words), -1).to_numpy().astype(np.int32) + 1
        mixed = np.flatnonzero(~plain)
        runs = [[self.number.get(w, 0) for w in WORD.findall(c.lower())] for c in cut.take(pa.array(mixed)).to_pylist()]
        size = np.ones(len(cut), np.int64)
        size[mixed] = list(map(len, runs))
        first = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int32)
        flat[first[plain]] = number[plain]
        for at, run in zip(first[mixed].tolist(), runs):
            flat[at : at + len(run)] = run
        flat, n = in_a_row(flat, size, words.indices.to_numpy())
        ends = np.append(0, np.cumsum(n))[np.cumsum(np.append(0, lists.value_lengths().to_numpy()))]
        return flat, np.diff(ends)

    def windows(self, places: np.ndarray, first: np.ndarray, size: np.ndarray, n: int, row: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Starts of the windows of n words with enough of the benchmark's pairs, which stand at ``places`` of ``row``.

        ``first`` and ``size`` are of the text of each place; a text shorter than n words has one window. ``words`` counts
        the benchmark's words before each place of ``row``.
        """
        need = n - 1 - 2 * allowed(n)
        if need <= 0:  # items of a few words: every window that starts at one of their words, or up to its edits before it
            at = np.flatnonzero(row > 0)
            return np.unique(np.concatenate([np.maximum(at - k, 0) for k in range(allowed(n) + 1)])) if len(at) else at
        if len(places) < need:
            return np.zeros(0, np.int64)
        dense = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] <= n - 2)
        last = np.maximum(first[dense], first[dense] + size[dense] - n)
        low = np.clip(places[dense + need - 1] - (n - 2), first[dense], last)
        high = np.clip(places[dense], first[dense], last)
        count = high - low + 1
        starts = np.unique(np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum()))
        # the window that begins where the passage does also has all the item's words but for the edits
        return starts[words[np.minimum(starts + n, len(row))] - words[starts] >= n - allowed(n)]

    def hits(self, texts: pa.Array | list[str | None]) -> list[list[dict]]:
        """For each text the items that it holds, with edits and place, by item and place."""
        out: list[list[dict]] = [[] for _ in texts]
        if not self.tables:
            return out
        longest = max(self.tables)
        flat, size = self.numbers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        numbered = np.split(flat, np.cumsum(size)[:-1])
        first = np.cumsum(size + longest) - size - longest  # texts stand apart, so no window has words of two
        row = np.full(int((size + longest).sum()), NO_WORD, np.int64)
        row[np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(flat))] = flat
        known = np.flatnonzero((row[:-1] > 0) & (row[1:] > 0))
        pair = row[known] << 32 | row[known + 1]
        if len(self.pairs):
            known = known[self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair]
        else:
            known = known[:0]
        owner = np.searchsorted(first, known, "right") - 1
        words = np.concatenate([[0], np.cumsum(row > 0)])
        windows = {n: self.windows(known, first[owner], size[owner], n, row, words) for n in self.tables}
        met: dict[int, list[np.ndarray]] = {}
        starts = np.unique(np.concatenate(list(windows.values())))
        for k in range(0, len(starts), AT_ONCE):
            part = starts[k : k + AT_ONCE]
            for item, at in self._meetings(row, part, {n: w[np.searchsorted(w, part[0]) : np.searchsorted(w, part[-1], "right")] for n, w in windows.items()}):
                met.setdefault(item, []).append(at)
        for item, parts in met.items():
            for at in self._near(item, row, np.unique(np.concatenate(parts))):
                text = int(np.searchsorted(first, at[0], "right")) - 1
                self._verify(out[text], item, numbered[text], at - first[text], 0, len(numbered[text]))
        for found in out:
            found.sort(key=lambda h: (h["item_id"], h["start_word"], h["edits"]))
        return out

    def _meetings(self, row: np.ndarray, starts: np.ndarray, windows: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Items and the window starts at which one of their tables has both; ``starts`` has all of ``windows`` (length -> starts)."""
        windows = {n: w for n, w in windows.items() if len(w)}
        columns = {n: np.searchsorted(starts, w) for n, w in windows.items()}
        for number in range(WALKS):
            walked = walk(row, starts, STEPS * max(windows, default=0), number)
            for n, of in columns.items():
                keys = table_keys(walked, of, n, -2, number).ravel()
                known, item = self.tables[n]
                low = np.searchsorted(known, keys, "left")
                full = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == keys)
                low, high = low[full], np.searchsorted(known, keys[full], "right")
                count = high - low
                at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                pairs = np.unique(item[at] << 40 | windows[n][np.repeat(full % len(of), count)])
                items, cuts = np.unique(pairs >> 40, return_index=True)
                for k, found in zip(items.tolist(), np.split(pairs & (1 << 40) - 1, cuts[1:])):
                    yield k, found

    def _near(self, k: int, row: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Runs of the window starts ``at`` around which enough words and pairs of item k stand: no edit within the limit takes more away."""
        n, slack = len(self.items[k]), allowed(len(self.items[k]))
        near = row[np.clip(at[:, None] + np.arange(-slack, n + slack), 0, len(row) - 1)]
        words = np.isin(near, self.items[k])
        enough = words.sum(axis=1) >= n - slack
        if n - 1 > 2 * slack:
            pair = near[enough][:, :-1] << 32 | near[enough][:, 1:]
            enough[enough] = (np.isin(pair, self.own_pairs[k]) & words[enough][:, :-1]).sum(axis=1) >= n - 1 - 2 * slack
        at = at[enough]
        return np.split(at, np.flatnonzero(np.diff(at) > n + 2 * slack) + 1) if len(at) else []

    def _verify(self, found: list[dict], k: int, x: np.ndarray, at: np.ndarray, low: int, high: int) -> None:
        """Add the places of item k in text x, between ``low`` and ``high``, at or near the window starts ``at``: the best, then those beside it."""
        item = self.items[k]
        n, slack = len(item), allowed(len(item))
        work = [(at, low, high)]  # a list and no recursion: a text may repeat an item as often as it likes
        while work:
            at, low, high = work.pop()
            exact = next((s for s in map(int, at) if low <= s <= high - n and (x[s : s + n] == item).all()), None)
            if exact is not None:
                edits, start, end = 0, exact, exact + n
            else:
                begin = max(low, int(at[0]) - slack)
                edits, start, end = best_match(item, x[begin : max(begin, min(high, int(at[-1]) + n + slack))])
                start, end = begin + start, begin + end
            if edits > slack:
                continue
            found.append({"item_id": self.ids[k], "edits": edits, "start_word": start, "n_words": end - start})
            before, after = at[at <= start - n + slack], at[at >= end - slack]
            if len(after):
                work.append((after, end, high))
            if len(before):
                work.append((before, low, start))


def benchmark_blocks(items: DataFrame) -> Iterator[Benchmark]:
    """``items`` (item_id, text) in blocks of about BLOCK_CHARS; rows without an id or a word are no items."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text")
    blocks = -(-(rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0) // BLOCK_CHARS)
    for k in range(blocks):
        yield Benchmark.of([(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()])


def find(df: DataFrame, items: DataFrame, text: str = "text", out: str = "hits") -> DataFrame:
    """``df`` with ``out``: every place of its whole text that holds an item within the distance, with edits and place in words.

    The benchmark is the query set and goes to the tasks in blocks of bounded size; every row of ``df`` meets every block,
    and with more than one block the rows are written after each. Places of one item don't overlap; of overlapping ones the
    one with the fewest edits counts. Null and empty texts, and tables without items, have no hits. An item id that stands
    twice counts as two items. Repeated rows pass; a column named ``out`` is replaced, unless it is ``text`` itself (an error).
    """
    if out == text:
        raise ValueError("out and text are one column")

    def column(bench: Benchmark):
        shared = df.sparkSession.sparkContext.broadcast(bench)

        @F.arrow_udf(HITS)
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                rows, n = [], len(texts)
                for k in range(0, n, TEXTS_AT_ONCE):
                    rows += shared.value.hits(texts.slice(k, TEXTS_AT_ONCE))
                yield pa.array(rows, pa.list_(HIT))

        return of(F.col(f"`{text}`"))

    found, blocks = df.withColumn(out, F.array().cast(HITS)), benchmark_blocks(items)
    first = next(blocks, None)
    if first is None:
        return found
    found = df.withColumn(out, column(first))
    for block in blocks:
        found = staged(found, "hits")
        found = found.withColumn(out, F.concat(F.col(f"`{out}`"), column(block)))
    return found
