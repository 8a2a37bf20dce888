"""Connected components of a graph of any size, as a loop of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that edges (a, b, longs) reach, for every node of an edge.

    A round takes the least label among neighbours and then that of its label, so paths halve. Hubs are safe: least
    labels are pre-aggregated, and the joins are plain shuffle joins, whose large keys Spark splits.
    """
    both = common.written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        new = common.written(new, "labels")
        up = new.select(F.col("node").alias("up"), F.col("label").alias("far"))
        new = common.written(new.join(up, new.label == up.up).select("node", "old", F.least("label", "far").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
