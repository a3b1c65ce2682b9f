"""Connected components of an edge table, by local union-find and star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, parts


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = UnionFind()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found.union(x, y)
    nodes = list(found.up)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([found.find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (u long, v long); component is its smallest node.

    Each partition's union-find first turns its edges into stars. Then every node's neighbours are
    linked to the smallest of them, alternately the larger ones and the smaller ones (large-star,
    small-star), until no edge changes; a hub's edges are only ever summed by min and joined, never
    gathered. Each round is cut by a table in the shared folder.
    """
    n = parts(edges.sparkSession)
    e = edges.where("u <> v").repartition(n, "v").mapInArrow(_contract, "u long, v long")
    e = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # done if each node has one edge up and no root has any
        parents = e.groupBy("u").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v"))
        roots = e.select(F.col("v").alias("u")).distinct()
        many = parents.where("c > 1").limit(1).count() or roots.join(parents, "u", "left_semi").limit(1).count()
        if not many:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "edges")
