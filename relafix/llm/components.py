"""Connected components over an edge table, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relafix.storage import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; the label is the component's smallest node.

    Each round every node takes the smallest label among itself and its
    neighbours, then the label of its label, so chains shorten by half or more.
    Sums per node are pre-aggregated and the joins are ordinary ones, so a node
    with very many neighbours is split by adaptive execution.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        spread = cut(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "low").alias("label"), F.col("label").alias("old")))
        jump = spread.select(F.col("node").alias("at"), F.col("label").alias("to"))
        jumped = cut(spread.join(jump, F.col("label") == F.col("at"), "left").select("node", F.least("label", F.coalesce("to", "label")).alias("label"), "old"))
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
