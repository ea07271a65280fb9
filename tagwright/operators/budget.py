"""Parts of a graph that fit a budget: nodes (node_id, label, seq, properties map) and edges (relationship_id, from_node_id, to_node_id, seq, properties map).

Of the graph only what the budget could buy goes on: the first nodes by order, and of the edges that one more node makes
possible the first by order. What is left is bounded by the budget alone, so spending it in turn is one small group.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwright.operators.graph import cut, induced

# What a node, an edge and a property cost, the largest budget, and after how many nodes one edge or two more are tried.
NODE, EDGE, PROPERTY, MOST = 2, 4, 1, 1000
EACH, EXTRA_EACH, EXTRA = 2, 10, 2
SMALL = 100_000  # nodes that are broadcast
SPENT = "kind string, id string, place long, n_kept long"


def _spend(budget: int, properties: bool):
    """Spends a budget on nodes by place and on edges by order, an edge once both its ends are there."""

    def spend(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows[rows["kind"] == "node"].sort_values("ready")
        edges = rows[rows["kind"] == "edge"].sort_values(["ready", "seq", "id"])
        waiting = list(zip(edges["ready"], edges["seq"], edges["id"], edges["n_properties"]))[::-1]
        left, possible, taken_nodes, taken_edges = budget, [], [], []

        def edge() -> bool:
            nonlocal left
            while waiting and waiting[-1][0] <= len(taken_nodes):
                heapq.heappush(possible, waiting.pop()[1:])
            if left < EDGE or not possible:
                return False
            taken_edges.append(heapq.heappop(possible))
            left -= EDGE
            return True

        for own in zip(nodes["id"], nodes["n_properties"]):
            if left < NODE:
                break
            taken_nodes.append(own)
            left -= NODE
            if len(taken_nodes) % EACH == 0:
                edge()
            if len(taken_nodes) % EXTRA_EACH == 0:
                for _ in range(EXTRA):
                    if not edge():
                        break
        if len(taken_nodes) == len(nodes):
            while edge():
                pass
        out = []
        for kind, taken in (("node", taken_nodes), ("edge", [(i, n) for _, i, n in taken_edges])):
            for place, (i, n) in enumerate(taken, 1):
                kept = min(left // PROPERTY, n) if properties else 0
                left -= kept * PROPERTY
                out.append((kind, i, place, kept))
        return pd.DataFrame(out, columns=["kind", "id", "place", "n_kept"])

    return spend


def _first(properties: Column, n: Column) -> Column:
    return F.map_from_entries(F.slice(F.map_entries(properties), F.lit(1), n.cast("int")))


def _bought(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None, budget: int, properties: bool) -> tuple[DataFrame, DataFrame]:
    size = F.coalesce(F.size("properties"), F.lit(0)) if properties else F.lit(0)
    number = lambda c: F.greatest(F.when(size > 0, size).otherwise(0), F.lit(0)).cast("long").alias(c)
    some = nodes.orderBy("seq", "node_id").limit(max(budget // NODE, 1))
    some = cut(some.withColumn("_rank", F.row_number().over(Window.orderBy("seq", "node_id"))))  # MOST / NODE rows at most
    ranks = some.select("node_id", "_rank")
    if seeds is not None:
        ranks = ranks.union(seeds.select("node_id", F.lit(0)).distinct())
    end = lambda side: ranks.select(F.col("node_id").alias(side), F.col("_rank").alias(f"_{side}"))
    ready = edges.join(end("from_node_id"), "from_node_id").join(end("to_node_id"), "to_node_id").withColumn("_ready", F.greatest("_from_node_id", "_to_node_id"))
    # of edges that become possible together no more than the budget buys; the first of a hub's are found before they move
    first = F.row_number().over(Window.partitionBy("_ready").orderBy("seq", "relationship_id"))
    ready = cut(ready.withColumn("_first", first).where(F.col("_first") <= max(budget // EDGE, 1)).drop("_first", "_from_node_id", "_to_node_id"))
    rows = some.select(F.lit("node").alias("kind"), F.col("_rank").cast("long").alias("ready"), F.col("seq").cast("double"), F.col("node_id").alias("id"), number("n_properties"))
    rows = rows.union(ready.select(F.lit("edge"), F.col("_ready").cast("long"), F.col("seq").cast("double"), "relationship_id", number("n_properties")))
    spent = cut(rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_spend(budget, properties), SPENT))
    chosen = lambda kind, key: F.broadcast(spent.where(F.col("kind") == kind).select(F.col("id").alias(key), "place", "n_kept"))
    keep = lambda df: df.withColumn("properties", F.when(F.col("n_kept") > 0, _first(F.col("properties"), F.col("n_kept")))).drop("n_kept")
    return keep(some.drop("_rank").join(chosen("node", "node_id"), "node_id")), keep(ready.drop("_ready").join(chosen("edge", "relationship_id"), "relationship_id"))


def sample(nodes: DataFrame, edges: DataFrame, budget: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, each with ``place``, that a budget of 1 to MOST buys in turn.

    Nodes come by ``seq``. After every second node the first edge by ``seq`` whose ends are both there is bought, after every
    tenth up to two more; with no node left, edges until the budget ends. What remains buys properties, of the nodes first. Edges
    to nodes that are not bought are none. Ties go by id; an edge id that repeats is bought as often.
    """
    return _bought(nodes, edges, None, max(1, min(MOST, budget)), True)


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, loaded: DataFrame, budget: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Of the ``seeds``' neighbours, and of edges among both that are not ``loaded`` (relationship_id), what a budget buys; no properties."""
    ways = edges.select(F.col("from_node_id").alias("node_id"), F.col("to_node_id").alias("other")).union(edges.select("to_node_id", "from_node_id"))
    near = ways.join(seeds.select("node_id").distinct(), "node_id", "left_semi").select(F.col("other").alias("node_id")).distinct()
    near = nodes.join(near, "node_id", "left_semi").join(seeds, "node_id", "left_anti")
    new = edges.join(loaded.select("relationship_id"), "relationship_id", "left_anti")
    return _bought(near, new, seeds, max(1, min(MOST, budget)), False)


def by_parents(nodes: DataFrame, edges: DataFrame, label: str = "Plant", most: int = 50) -> tuple[DataFrame, DataFrame]:
    """At most ``most`` nodes (with ``place``), breadth first from those of a label, and the edges among them.

    A hop takes the first child (by id) of every parent before the second ones; of these rows, ten times as many as places are
    left are looked at, repeats and nodes that are already there included. A label's own nodes go by id.
    """
    most = most if most and most > 0 else 50
    found = nodes.where(F.upper("label") == label.upper()).select("node_id").orderBy("node_id").limit(most)
    front = cut(found.withColumn("place", F.row_number().over(Window.orderBy("node_id"))))
    seen, n = front, front.count()
    last = n
    while last and n < most:
        rows = 10 * (most - n)
        step = edges.join(front.select(F.col("node_id").alias("from_node_id")), "from_node_id").select(F.col("from_node_id").alias("parent"), F.col("to_node_id").alias("node_id"))
        step = step.join(nodes.select("node_id"), "node_id", "left_semi")
        rank = F.row_number().over(Window.partitionBy("parent").orderBy("node_id"))
        looked = step.withColumn("_rank", rank).where(F.col("_rank") <= rows).orderBy("_rank", "parent").limit(rows)  # a hub is cut before it moves
        at = looked.withColumn("_at", F.row_number().over(Window.orderBy("_rank", "parent")))
        new = at.groupBy("node_id").agg(F.min("_at").alias("_at")).join(seen.select("node_id"), "node_id", "left_anti").orderBy("_at").limit(most - n)
        front = cut(new.select("node_id", (F.lit(n) + F.row_number().over(Window.orderBy("_at"))).alias("place")))
        last = front.count()
        seen, n = seen.union(front), n + last
    seen = F.broadcast(seen) if most <= SMALL else seen
    return nodes.join(seen, "node_id"), induced(edges, seen).dropDuplicates(["relationship_id"])
