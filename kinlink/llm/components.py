"""Connected components of a distributed edge table.

Alternating large-star and small-star steps, written as aggregations and joins so that a hub's neighbours never meet in one
task's memory. Before the first step every partition replaces its edges by those of its own spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut_lineage

#: Steps after which a graph counts as malformed; 2 log2(n) suffice.
MOST_STEPS = 80


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def local_forests(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of each partition as edges from every node to the smallest of its component there."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        forest = Forest()
        for batch in batches:
            pairs = np.unique(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), axis=0)
            for a, b in pairs.tolist():
                forest.join(a, b)
        return batches_of(((x, top) for x in list(forest.up) if (top := forest.root(x)) != x), schema)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long): root is the smallest node that can be reached."""
    now = cut_lineage(local_forests(edges.where("a <> b")).distinct())
    seen = None
    for _ in range(MOST_STEPS):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Now a > b in every edge: the smaller neighbours of each node and itself go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut_lineage(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
