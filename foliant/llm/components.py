"""Connected components of an edge table, without collecting it anywhere.

Each round contracts every node to the least of its neighbours and itself,
follows these pointers twice, renames the edges and drops loops; edges shrink at
least geometrically and rounds are few.  Tasks first replace their own edges by
a spanning forest, so no task or shuffle sees more edges than nodes per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


class Forest:
    """Union-find over any integers; roots are the least members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, a: int) -> int:
        parent = self.parent
        root = a
        while (up := parent.get(root, root)) != root:
            root = up
        while a != root:
            a, parent[a] = parent.get(a, a), root
        return root

    def join(self, a: int, b: int) -> bool:
        """True if a and b were apart until now."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(x, y)
    nodes = np.fromiter(forest.parent, np.int64, len(forest.parent))
    roots = np.fromiter(map(forest.find, nodes.tolist()), np.int64, len(nodes))
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(roots[i : i + (1 << 16)])], names=["src", "dst"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node with an edge to another; ``edges`` has src and dst, longs."""
    schema = "src long, dst long"
    e = written(edges.select("src", "dst").where("src <> dst").mapInArrow(_forest, schema), "edges")
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        p = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        for _ in range(2):  # every pointer names a node with an edge, so inner joins lose none
            p = written(p, "pointers")
            p = p.join(p.select(F.col("a").alias("p"), F.col("p").alias("_up")), "p").select("a", F.col("_up").alias("p"))
        p = written(p, "pointers")
        old = labels
        labels = p.select(F.col("a").alias("node"), F.col("p").alias("component"))
        if old is not None:
            moved = old.join(p, old["component"] == p["a"], "left").select("node", F.coalesce("p", "component").alias("component"))
            labels = written(moved, "labels")
        e = e.join(p.select(F.col("a").alias("src"), F.col("p").alias("_s")), "src").join(p.select(F.col("a").alias("dst"), F.col("p").alias("_d")), "dst")
        e = written(e.where("_s <> _d").select(F.col("_s").alias("src"), F.col("_d").alias("dst")).distinct().mapInArrow(_forest, schema), "edges")
    if labels is None:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return labels
