"""Connected components of a large edge table by alternating large-star and small-star steps.

Edges are first contracted inside each partition to a forest of stars, so what is shuffled is bounded by the nodes a
partition sees. Every step is a grouped minimum and a join on the node; Spark may split a node with very many edges.
After it, edges are dealt to parts of about EDGES_A_TASK and contracted again, so long chains shorten by whole stretches.
Once what is left is a single part, its contraction is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairpref.session import stored

#: Edges that one task contracts at once.
EDGES_A_TASK = 200_000


class Forest:
    """Union-find over integers; the smallest member is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            forest.union(u, v)
    found = [(x, r) for x in list(forest.parent) if (r := forest.root(x)) != x]
    if found:
        u, v = np.array(found, np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(node, component) for every node that occurs in ``edges`` (u, v: long) with another; the smallest id names it."""
    contracted = lambda some: stored(some.mapInArrow(_contract, "u long, v long"))
    now = contracted(edges.where("u <> v"))
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] <= edges_a_task:
            now = contracted(now.repartition(1))
        if mark == state or mark[0] <= edges_a_task:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        left = small.union(lowest.select("u", F.col("m").alias("v"))).where("u <> v")
        now = contracted(left.repartition(-(-mark[0] // edges_a_task), "u", "v"))
