"""Conversation prefix trie: conversations as paths of turns, sorted over the whole cluster, swept into nodes.

A path is a conversation's turns one after the other, ``WIDTH`` bytes each. Sorted paths that share a prefix follow each other,
so a node of the trie is an interval of the sort. Each partition is swept once with a stack: the common prefix of a path
and the one before it (their LCP) says which nodes end. A node that ends inside a partition is whole. The nodes on a partition's first
and last path may go on in the partitions beside it: these open stacks are put together by the node's name, and swept once more for what their subtrees hold.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwright.llm.shared import staged, within

NAME, LENGTH = 16, 8  # bytes of a turn's digest and of its text's length
WIDTH = NAME + LENGTH
HEAD = 8  # turns that another conversation can take over
PENDING = 20_000  # children that a node holds back until its smallest member is known
ROWS_AT_ONCE = 10_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODE, OPEN, END, NAMED = range(4)
COLUMNS = pa.schema([("kind", pa.int32()), ("id", pa.binary()), ("parent_id", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("n_bytes", pa.int64()), ("part", pa.int32()), ("row", pa.int64())])
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_paths(turns: DataFrame) -> DataFrame:
    """conv_id, path of every conversation of ``turns`` (conv_id, turn, role, text), by turn (null first), then by the turn's digest.

    A null role or text is empty; rows without a conversation belong to none. Texts become digests before rows move. A path must fit a row.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME))
    key = F.concat(name, F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * LENGTH, "0")))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", key.alias("key"))
    # conversations that share a head lie together, so that ``rebuilt`` moves nothing
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).repartition("base")
    return rows.groupBy("base", "conv_id").agg(F.expr("listagg(key) within group (order by turn asc nulls first, key)").alias("path"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """conv_id, path of conversations that begin with the head of another: of ``conv_id - conv_id % 5`` the first crc32(conv_id) % 9 turns."""
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.substring("path", 1, HEAD * WIDTH))).over(Window.partitionBy("base"))
    n = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (HEAD + 1) * WIDTH).cast("int")
    taken = F.substring(F.coalesce(F.col("_head"), F.unhex(F.lit(""))), F.lit(1), n)
    return paths.withColumn("_head", head).select("conv_id", F.concat(taken, F.substring("path", n + 1, F.octet_length("path"))).alias("path"))


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while high - low > 1:  # the first ``low`` are alike, the first ``high`` are not
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid)
    return low


def names(path: bytes, depth: int) -> list[bytes]:
    """Names of the path's nodes from the root down to a depth."""
    out = [b""]
    for k in range(depth):
        out.append(hashlib.sha256(out[-1] + path[k * WIDTH : (k + 1) * WIDTH]).digest()[:NAME])
    return out


class Node:
    """A node on the stack: what its closed part holds so far."""

    __slots__ = ("depth", "row", "size", "conv", "n", "children", "leaves", "saved", "ends", "pending", "named")

    def __init__(self, depth: int, row: int, size: int):
        self.depth, self.row, self.size = depth, row, size
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.pending, self.named = array("q"), [], None

    def add(self, conv: int, n: int, child: bool = False, leaves: int = 0, saved: int = 0) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + child, self.leaves + leaves, self.saved + saved

    def total(self) -> tuple[int, int, int]:
        return self.children, self.leaves if self.children else 1, self.saved + (self.n - 1) * self.size


class Sweep:
    """One partition's paths in order, as rows of COLUMNS: whole nodes, open ones, ends of open ones, names of nodes whose children went ahead."""

    def __init__(self, part: int):
        self.part, self.stack, self.last, self.rows, self.out = part, [], b"", 0, []

    def take(self, conv: int, path: bytes) -> None:
        if self.rows:
            shared = lcp(self.last, path)
            self.close(shared)
            self.on_first = min(self.on_first, shared)
        else:
            self.first, self.on_first, shared, self.stack = path, len(path) // WIDTH, 0, [Node(0, 0, 0)]
        for k in range(shared, len(path) // WIDTH):
            self.stack.append(Node(k + 1, self.rows, int.from_bytes(path[k * WIDTH + NAME : (k + 1) * WIDTH], "big")))
        self.last, self.rows = path, self.rows + 1
        top = self.stack[-1]
        top.add(conv, 1)
        top.ends.append(conv)

    def close(self, depth: int) -> None:
        """Take the nodes below a depth off the stack; those on the first path stay open."""
        named = None
        while self.stack[-1].depth > depth:
            node = self.stack.pop()
            if node.depth <= self.on_first:
                named = named or names(self.first, node.depth)
                self.open(node, named)
            else:
                self.whole(node)

    def whole(self, node: Node) -> None:
        children, leaves, saved = node.total()
        for row in node.pending:
            self.out.append((*row[:5], node.conv, *row[6:]))
        if node.named is not None:
            self.out.append((NAMED, node.named, None, node.conv) + (None,) * 10)
        parent = self.stack[-1]
        parent.add(node.conv, node.n, True, leaves, saved)
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else EMPTY
        parent.pending.append((NODE, None, parent.named, node.conv, node.depth, None, node.n, children, leaves, saved, ends, None, None, None))
        if len(parent.pending) >= PENDING:
            if parent.named is None:
                parent.named = names(self.last, parent.depth)[-1]
            self.ahead(parent)

    def ahead(self, node: Node) -> None:
        """The children held back go on with the name of their parent."""
        self.out += [(NODE, None, node.named, *row[3:]) for row in node.pending]
        node.pending = []

    def open(self, node: Node, named: list[bytes]) -> None:
        node.named = named[node.depth]
        self.ahead(node)
        self.out.append((OPEN, node.named, None, node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved, None, node.size, self.part, node.row))
        self.out += [(END, node.named, None, conv) + (None,) * 10 for conv in node.ends]

    def end(self) -> None:
        if self.rows:
            named = names(self.last, self.stack[-1].depth)
            while self.stack:
                self.open(self.stack.pop(), named)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), COLUMNS)], schema=COLUMNS)


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = Sweep(TaskContext.get().partitionId())
    for batch in batches:
        for conv, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sweep.take(conv, path)
            while len(sweep.out) >= ROWS_AT_ONCE:
                yield batch_of(sweep.out[:ROWS_AT_ONCE])
                sweep.out = sweep.out[ROWS_AT_ONCE:]
    sweep.end()
    for k in range(0, len(sweep.out), ROWS_AT_ONCE):
        yield batch_of(sweep.out[k : k + ROWS_AT_ONCE])


def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes in the order of the trie (a node before its children): each with all that its subtree holds."""
    stack: list[tuple[Node, bytes, str]] = []

    def close(depth: int) -> Iterator[tuple]:
        while stack and stack[-1][0].depth >= depth:
            node, name, ends = stack.pop()
            children, leaves, saved = node.total()
            yield from ((*row[:5], node.conv, *row[6:]) for row in node.pending)
            row = (OPEN, name, None, node.conv, node.depth, None, node.n, children, leaves, saved, ends, None, None, None)
            if stack:
                stack[-1][0].add(node.conv, node.n, True, leaves, saved)
                stack[-1][0].pending.append(row)
            else:
                yield row

    for batch in batches:
        for r in batch.to_pylist():
            if out := list(close(r["depth"])):
                yield batch_of(out)
            node = Node(r["depth"], 0, r["n_bytes"])
            node.conv, node.n, node.children, node.leaves, node.saved = r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]
            stack.append((node, r["id"], r["ends_sha256"] or EMPTY))
    if out := list(close(0)):
        yield batch_of(out)


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, ends_sha256 of rows (id, conv_id) in order: a node's ids stream through its hash, however many they are."""
    now, digest = None, None
    done = lambda: pa.RecordBatch.from_pydict({"id": pa.array([now], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()])})
    for batch in batches:
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == now:
                digest.update(b",%d" % conv)
            else:
                if digest:
                    yield done()
                now, digest = name, hashlib.sha256(b"%d" % conv)
    if digest:
        yield done()


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id long, path), the root included: RESULT columns.

    conv_id is a node's smallest member; parent_conv_id its parent's (null for the root); n_convs its members; n_children, n_leaves
    (nodes without children in its subtree, itself included); saved_tokens: (members - 1) times the bytes of the last text, over its
    subtree; ends_sha256: of the ids of the conversations that end there, ascending, with commas. An empty table gives no rows,
    not even a root. A conversation that stands twice counts twice.

    Paths are sorted with their ids, so a group of equal conversations is many partitions; a partition holds its stack, the
    ids that end on it and at most PENDING children a node. What partitions leave open is two stacks each.
    """
    ordered = paths.select("conv_id", "path").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    kind = ", ".join(f"{f.name} {dict(int32='int', int64='long', binary='binary', string='string')[str(f.type)]}" for f in COLUMNS)
    rows = staged(ordered.mapInArrow(swept, kind), "trie")
    ends = rows.where(F.col("kind") == END).select("id", "conv_id").repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(hashed_ends, "id binary, ends_sha256 string")
    parts = rows.where(F.col("kind") == OPEN).groupBy("id").agg(F.min(F.struct("part", "row")).alias("at"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("n_bytes").alias("n_bytes"))
    in_order = parts.join(ends, "id", "left").repartition(1).sortWithinPartitions("at", "depth")
    stacks = staged(in_order.mapInArrow(stitched, kind), "stacks")
    named = stacks.select("id", "conv_id").union(rows.where(F.col("kind") == NAMED).select("id", "conv_id")).select(F.col("id").alias("parent_id"), F.col("conv_id").alias("_parent"))
    nodes = rows.where(F.col("kind") == NODE)
    here = nodes.where(F.col("parent_id").isNull()).select(*RESULT)
    ahead = nodes.where(F.col("parent_id").isNotNull()).join(within(named, 100_000), "parent_id").withColumn("parent_conv_id", F.col("_parent")).select(*RESULT)
    return here.union(ahead).union(stacks.select(*RESULT))
