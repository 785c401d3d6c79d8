"""Connected components of a link table, by least labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b): label is the least node reachable.

    Each round takes the least label among a node's neighbours and then the label of that label, so
    chains shrink geometrically. Every round is a written table, which cuts the lineage.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("over"))
        step = written(step.join(jump, "next", "left").select("node", "label", F.least("next", "over").alias("next")), "labels")
        changed = step.where("label <> next").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
