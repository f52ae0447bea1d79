"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges (a, b)``; a component is named by its least node.

    Each round maps every node to the least node next to it and draws the edges again between the results. A node that is not
    mapped to itself disappears, so the edges shrink at least by half of the nodes in them; the loop runs on the driver, the
    data never reach it. Null ends and loops are dropped.
    """
    left = cut(edges.select("a", "b").where("a <> b").distinct())
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up"))
        # One step further where the parent has a lesser parent itself.
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("over"))
        parent = cut(parent.join(above, "up", "left").select("node", F.coalesce("over", "up").alias("up")))
        if found is None:
            found = parent.select("node", F.col("up").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "up")
            found = cut(found.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("a2")), parent.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        drawn = left.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        left = cut(drawn.where("a <> b").distinct())
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
