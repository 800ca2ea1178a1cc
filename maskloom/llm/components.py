"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import removed, written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of `links` (a, b) reaches.

    Each round every node takes the least label around it and then that label's own label, so a chain of
    length d needs about log d rounds; a round is written out, and only its number of changes is collected.
    Nodes without a link do not occur.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = last = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("_around"))
        )
        near = labels.join(around, "node").select("node", F.col("label").alias("_old"), F.least("label", "_around").alias("label"))
        # the label's own label: labels are nodes, so this jumps over what earlier rounds found
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("_own"))
        jumped = written(near.join(own, "label").select("node", "_old", F.least("label", "_own").alias("label")))
        removed(last)
        labels, last = jumped.select("node", "label"), jumped
        if not jumped.filter("_old <> label").limit(1).count():
            removed(both)
            return labels
