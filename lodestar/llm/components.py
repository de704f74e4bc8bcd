"""Connected components of link tables of any size, by alternating stars.

Each round hangs every node's larger neighbours on its smallest neighbour, then
every node's smaller neighbours on the smallest of them; the number of rounds is
about the logarithm of the longest chain.  Links never leave the executors: a round
is two aggregations and two joins over staged tables.  A hub with many neighbours is a
skewed key of a join between two tables that are read from files, which adaptive
execution can split; it couldn't split one whose other side is an aggregation by the
same key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.scratch import drop, sized, stage


class Forest:
    """Disjoint sets over 0..n-1; a set is named by its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        """Root of every member."""
        return np.fromiter((self.find(i) for i in range(len(self.up))), np.int64, len(self.up))


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components with at most one link per node of a batch."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        at = at.reshape(2, -1)
        forest = Forest(len(nodes))
        for x, y in zip(at[0].tolist(), at[1].tolist()):
            forest.join(x, y)
        roots = forest.roots()
        hung = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[roots[hung]])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links`` (two long columns); the component is its smallest node.

    Nulls and links of a node to itself are ignored; repeated links count once.
    """
    x, y = (F.col(c) for c in links.columns)
    pairs = links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    stars = stage(pairs.mapInArrow(_thin, "a long, b long").distinct(), "stars")
    mark = None
    while True:
        lower = stage(stars.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "stars-lower")
        # A larger neighbour of b goes to b's own smallest neighbour, or stays with b.
        large = stage(stars.join(sized(lower), F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "stars-large")
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "stars-low")
        small = large.join(sized(low), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = stage(small, "stars")
        now = tuple(new.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        for table in (stars, lower, large, low):
            drop(table)
        stars = new
        if now == mark:
            break
        mark = now
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
