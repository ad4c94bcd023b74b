"""Connected components of an edge table, by hooking to the smallest neighbour and contracting.

Each round gives every node the smallest of itself and its neighbours (a sum with map-side
combine, so a node of any degree is fine), follows that pointer once more, relabels the
edges and drops those within a group. Nodes at least halve each round. Nothing but the number
of edges left reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component): the smallest node reachable, for all nodes with an
    edge to another one. Repeated edges, both directions and loops are fine; rows with a null
    end are ignored."""
    edge = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edge = put(edge.distinct(), "edges")
    labels = None
    while not edge.isEmpty():
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "hooks")
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = put(hook.join(up, "p").select("a", F.col("pp").alias("p")), "parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            labels = put(labels.join(parent, labels.component == parent.a, "left").select(
                "node", F.coalesce("p", "component").alias("component")), "labels")
        left, right = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        moved = edge.join(left, "a").join(right, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edge = put(moved.where("a < b").distinct(), "edges")
    if labels is None:
        t = edges.schema["a"].dataType
        return edge.select(F.col("a").cast(t).alias("node"), F.col("b").cast(t).alias("component"))
    return labels
