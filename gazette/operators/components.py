"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.shared import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the smallest node that it can reach.

    Each round takes the smallest label among a node and its neighbours and then that label's own label,
    so the distance to the smallest node falls by half or more; every round is written to the shared
    folder. A hub costs a row for each of its links, combined before the shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jumped = lowered.join(labels.select(F.col("node").alias("low"), F.col("label").alias("far")), "low").select("node", F.least("low", "far").alias("new"), "label")
        step = materialize(jumped, "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels
