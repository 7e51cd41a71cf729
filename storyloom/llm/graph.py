"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import saved


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Every round takes the smallest label among a node and its neighbours, then the label of that label, so that the
    number of rounds grows with the logarithm of the longest path in practice. Each round is written to the shared
    folder. Labels are combined before they are shuffled; the table of labels never leaves the executors.
    """
    both = edges.select(F.col(left).alias("x"), F.col(right).alias("y"))
    both = saved(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component"))
    labels = saved(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy("x").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = step.join(up, "component", "left").select("node", "was", F.least("component", "above").alias("component"))
        step = saved(step, "labels")
        labels = step.select("node", "component")
        if step.filter(F.col("was") != F.col("component")).isEmpty():
            return labels
