"""Connected components by least labels, on written tables instead of a growing lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import stored


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (src, dst, both directions) reach from each node. A round takes the least label
    among neighbours, then that of its label, so that paths halve."""
    labels = stored.written(nodes.select("node", F.col("node").alias("label")), "labels")
    edges = stored.written(edges.select("src", "dst").distinct(), "edges")
    while True:
        near = edges.join(labels, edges.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.node == near.src, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        far = new.select(F.col("node").alias("up"), F.col("label").alias("far"))
        new = stored.written(new.join(far, F.col("label") == F.col("up"), "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
