"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILES, ROWS_A_FILE, settle, settle_counted


#: Edges that one task makes stars of.
EDGES_A_TASK = 1 << 16
#: A node is heavy from so many edges on, or from this share of all: at most
#: 2 / HEAVY_SHARE nodes are, whose rows are broadcast.
HEAVY_EDGES, HEAVY_SHARE = 1000, 1 / 4096


def _with_least(edges: DataFrame, least: DataFrame, node: str, heavy: int) -> DataFrame:
    """edges with m, the least neighbour of their `node`; least: (node, m, n).

    The edges of a node with many (n >= heavy) are not shuffled: such nodes are
    few, and their least neighbours are broadcast.
    """
    few = F.broadcast(least.where(F.col("n") >= heavy).select(node, "m"))
    rest = edges.join(few.select(node), node, "left_anti")
    return edges.join(few, node).unionByName(rest.join(least.where(F.col("n") < heavy).select(node, "m"), node))


def _star(edges: DataFrame, large: bool, heavy: int) -> DataFrame:
    """One round over (u, v) with u < v; gives (u, v) with u < v, distinct.

    large: every larger neighbour of a node moves to the least of the node and
    its neighbours.  small: the node and its smaller neighbours move to the
    least of these.  Minima are aggregated before they are joined, and those of
    nodes with many edges are broadcast, so no node's neighbours need meet in
    one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        # Node u, larger neighbours v: each v goes to m.
        moved = _with_least(edges, least, "u", heavy).select(F.col("m").alias("u"), "v")
    else:
        least = edges.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        moved = _with_least(edges, least, "v", heavy).select(
            F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v")
        )
        moved = moved.unionByName(least.select(F.col("m").alias("u"), "v"))
    return moved.where("u < v").distinct()


def _contract(batches):
    """Stars (u, v) that connect what a task's edges connect, u the least of each."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        path = []
        while (up := root.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            root[p] = x
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    nodes = list(root)
    yield pa.record_batch([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["u", "v"])


def _is_star(edges: DataFrame) -> bool:
    """Whether every node v of (u, v) has one u, which is no node v itself."""
    ends = edges.select("v", F.lit(1).alias("n"), F.lit(False).alias("root")).unionByName(edges.select(F.col("u").alias("v"), F.lit(0).alias("n"), F.lit(True).alias("root")))
    return ends.groupBy("v").agg(F.sum("n").alias("n"), F.bool_or("root").alias("root")).where("n > 1 OR (n > 0 AND root)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (u, v); component is the least node.

    Edges may repeat, come in either direction, or lead from a node to itself.
    Tasks of EDGES_A_TASK edges first make stars of what they hold; if that is
    one task, all is done.  Else stars grow together in rounds.
    """
    now, n = settle_counted(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    if n:
        tasks = -(-n // EDGES_A_TASK)
        now = settle(now.repartition(tasks).mapInArrow(_contract, "u bigint, v bigint"), "edges", max(FILES, n // ROWS_A_FILE))
        heavy = max(HEAVY_EDGES, int(n * HEAVY_SHARE))
        while tasks > 1 and not _is_star(now):
            now = settle(_star(_star(now, True, heavy), False, heavy), "edges", max(FILES, n // ROWS_A_FILE))
    return now.select(F.col("v").alias("node"), F.col("u").alias("component"))
