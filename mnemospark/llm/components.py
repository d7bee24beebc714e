"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable. edges: (a long, b long), undirected.

    Each round gives a node the least label among its neighbours and then the label of its label, so the
    rounds grow with the logarithm of a path's length.  Labels are stored every round.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.join(labels.select(F.col("node").alias("via"), F.col("label").alias("far")), F.col("label") == F.col("via"), "left")
        new = stored(jump.select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
