"""Connected components of a graph given as a table of edges, for graphs of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emptied, stored


class UnionFind:
    """Sets of 0 .. n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the given edges connect."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = UnionFind(len(nodes))
    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
        sets.union(x, y)
    roots = nodes[[sets.find(i) for i in range(len(nodes))]]
    moved = roots != nodes
    return nodes[moved], roots[moved]


#: Edges that a task contracts at a time.
CONTRACTED = 200_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges that connect the same nodes: each task replaces its own by stars."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            a = np.concatenate([np.asarray(b.column("a")) for b in held])
            b = np.concatenate([np.asarray(b.column("b")) for b in held])
            high, low = spanning_stars(a, b)
            return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CONTRACTED:
                yield flush()
                held = []
        if held:
            yield flush()

    return edges.mapInArrow(run, "a bigint, b bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), component its smallest node.

    Large-star and small-star steps in turn, on edges that each task has contracted first; every round is written to the shared folder.
    Self-loops count for nothing; null ends are left out.
    """
    edges = stored(_contracted(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")).distinct(), "edges")
    while True:
        # large star: each node's larger neighbours go to the smallest node around it
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        stars = around.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours go to the smallest of these
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        linked = stars.join(least, "a")
        stars = linked.select("a", F.col("m").alias("b")).unionByName(linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, edges = edges, stored(_contracted(stars).distinct(), "edges")
        emptied(before)
        # done when each node has one edge, to a smaller node that has none of its own
        if not edges.groupBy("a").count().where("count > 1").head(1) and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").head(1):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
