"""Connected components of a large edge list by repeated contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); the component is its smallest node.

    Each round joins every root with the smallest root beside it and follows these pointers, so the number of roots
    at least halves. Nothing is collected; duplicated edges, loops and a node with a third of all edges are fine (a
    minimum combines before it is shuffled). An empty edge list gives an empty result.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialize(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("root"), F.least("a", "p").alias("p"))
        parent = materialize(parent, "parent")
        for _ in range(3):
            up = parent.select(F.col("root").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("root", F.coalesce("pp", "p").alias("p"))
        parent = materialize(parent, "parent")
        labels = materialize(
            labels.join(parent.withColumnRenamed("root", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels"
        )
        pa, pb = parent.select(F.col("root").alias("a"), F.col("p").alias("x")), parent.select(F.col("root").alias("b"), F.col("p").alias("y"))
        e = materialize(
            e.join(pa, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
    return labels
