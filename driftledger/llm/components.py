"""Connected components of a link table, by repeated joins; no link, label or node reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_staged, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component. Nodes without a link have no row.

    Each round takes the smallest label among a node's neighbours and then the label of its label, so that labels cross
    long chains in a number of rounds that grows with the logarithm of their length; rounds go on until nothing moves.
    Each round's table is written to the shared folder.
    """
    both = staged(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        stepped = staged(moved.join(jump, "to").select("node", F.least("to", "next").alias("label"), "was"), "labels")
        changed = stepped.where("label <> was").limit(1).count()
        drop_staged(labels)
        path, labels = stepped._staged_path, stepped.select("node", "label")
        labels._staged_path = path
        if not changed:
            drop_staged(both)
            return labels
