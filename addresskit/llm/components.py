"""Connected components of a graph given as pairs of longs, by alternating large and small stars.

A large star links every greater neighbour of a node to the least one, a small star every smaller neighbour and the node
itself. Both keep the components, each round is two aggregations and joins on the node, and the graph ends as stars
around each component's least node. Every round is written, so lineage stays short; rounds end when only stars are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(neighbours: DataFrame, keep: str) -> DataFrame:
    """Each node's neighbours linked to the least of them and the node; ``keep`` says which neighbours."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return neighbours.where(keep).join(least, "u")


def _stars_only(e: DataFrame) -> bool:
    """Whether every node has one lesser neighbour at most, and none where it is one itself."""
    to = e.select(F.col("u").alias("node"), "v").union(e.select(F.col("v").alias("node"), "v"))
    return to.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge with the least node of its component. Loops and repeats are fine."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    while not _stars_only(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, "true")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(small, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components ``labels`` (node, root) after more ``edges`` (a, b): only roots that an edge joins are clustered anew."""
    if labels is None:
        return written(components(edges), "labels")
    if edges.isEmpty():
        return labels

    def to_root(df, c):
        own = labels.select(F.col("node").alias(c), F.col("root").alias("_root"))
        return df.join(own, c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")

    moved = written(components(to_root(to_root(edges.select("a", "b"), "a"), "b")), "moved")
    old = labels.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    new = moved.join(labels, "node", "left_anti")
    return written(old.select("node", F.coalesce("_to", "root").alias("root")).unionByName(new), "labels")
