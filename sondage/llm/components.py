"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a group-by or a join on a node, written to the shared folder, so
that no link or component is gathered on the driver or in one task; nodes with
very many links are met by Spark's splitting of skewed joins, for which both
sides of each join are exchanged on their own. Before the first step the links
of each partition are thinned to a spanning forest.

Links with a null end or with equal ends are left out; repeated ones count once.
An empty table gives an empty one. Ends must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Links that a task holds while thinning them; thinning starts afresh beyond it.
THIN = 500_000


class Forest(dict):
    """Union-find over integers; the root of a set is its smallest member."""

    def root(self, x: int) -> int:
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while (up := self.get(x, x)) != top:
            self[x] = top
            x = up
        return top

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self) if (r := self.root(x)) != x]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(forest: Forest) -> pa.RecordBatch:
        edges = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.link(x, y)
        if len(forest) > THIN:
            yield out(forest)
            forest = Forest()
    yield out(forest)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node it is joined with."""
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a != b).alias("_")).where("_").drop("_")
    edges = materialise(edges.mapInArrow(_thin, "u long, v long").distinct(), "links")
    while True:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        below = F.count_if(F.col("m") < F.col("n"))
        # In a star a node has one smaller neighbour and no other, or only larger ones.
        least = both.groupBy("n").agg(F.min("m").alias("m"), ((below > 1) | (below > 0) & (F.count("*") > below)).alias("open"))
        least = materialise(least.select("n", F.least("n", "m").alias("m"), "open"), "least")
        if not least.where("open").limit(1).count():
            discard(least)
            break
        large = materialise(edges.join(least, edges["v"] == least["n"]).select("u", least["m"].alias("v")), "large")
        small = materialise(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "small")
        moved = large.join(small, large["u"] == small["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        used = (edges, least, large, small)
        edges = materialise(moved.union(small.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        discard(*used)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
