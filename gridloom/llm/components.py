"""Connected components of a distributed edge list.

Each task first reduces its edges to a forest with union-find, so at most one
edge a node and task remains. Rounds of large-star and small-star (Kiveris et
al., Connected Components in MapReduce and Beyond, 2014) then turn the forest
into stars around the smallest node of each component. Every round is written
to the shared folder. Nodes are never collected; hubs are joined, not grouped,
so adaptive execution can split them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialize


class Forest:
    """Union-find with path halving; the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        """(node, root) of every node that isn't a root."""
        pairs = [(x, r) for x in self.up if (r := self.find(x)) != x]
        return [x for x, _ in pairs], [r for _, r in pairs]


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            forest.join(a, b)
    low, high = forest.edges()
    yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = edges.join(least, edges["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Edges to itself or with a null end are ignored; order and repeats don't matter; without edges the result is empty.
    """
    usable = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    stars = materialize(usable.mapInArrow(lean(local_forest), "a long, b long"), "forest")
    while True:
        shape = stars.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        inner = stars.join(stars.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() if shape.n == shape.nodes else 1
        if not inner:
            break
        stars = materialize(_large_star(_small_star(stars)), "stars")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
