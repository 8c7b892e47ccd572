"""Connected components of an edge table, without collecting edges anywhere.

Edges are first contracted inside each partition, then rounds of large stars (every larger
neighbour of a node goes to the smallest) and small stars (every smaller neighbour does) follow
until nothing changes; each round starts from a table in the shared checkpoint folder.  A node
with many neighbours is met with partial minima and with joins that adaptive execution may split.
A table of at most FEW_EDGES contracted edges is finished by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Edges that one task may contract: about 40 MB of its memory.
FEW_EDGES = 200_000


class Forest:
    """Union-find over any hashable nodes; the smallest node of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):  # noqa: ANN001, ANN201
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root and x != root:
            up[x] = root
            x = y
        return root

    def union(self, x, y) -> bool:  # noqa: ANN001
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        self.up.setdefault(x, x)
        return True


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition -> one edge from each node to the smallest it is tied to there."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
    nodes = [x for x in forest.up if forest.find(x) != x]
    for k in range(0, len(nodes), 100_000):
        part = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.find(x) for x in part], pa.int64())], names=["a", "b"])


def _tell(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) -> (node, root): each node of an edge that is not its component's smallest node, and that node."""
    # written first, so that the Python workers that made the edges are not doubled by those that contract them
    now = materialise(materialise(edges.filter("a <> b")).mapInArrow(contract, "a long, b long"))
    before = _tell(now)
    while True:
        if before[0] <= FEW_EDGES:
            now = now.repartition(1).mapInArrow(contract, "a long, b long")
            return materialise(now).select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # every edge now points from a larger to a smaller node
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        hop = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = materialise(hop.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        after = _tell(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each of n nodes under edges (a[i], b[i]): the smallest node of the component."""
    forest = Forest()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        forest.union(x, y)
    return np.array([forest.find(x) for x in range(n)], dtype=np.int64)
