"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.llm.common import freed, sorted_side, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach, for every node in a link.

    Each round takes the smallest label around a node, then that label's own label, so
    the rounds grow with the logarithm of a chain's length. Labels are stored between
    rounds; joins are of links and labels, which Spark can split at a hub's links.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    both = stored(both, "component-links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    labels = held = stored(labels, "component-labels")
    while True:
        around = both.join(sorted_side(labels.select(F.col("node").alias("b"), "label")), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(sorted_side(around.withColumnRenamed("a", "node")), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        onward = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        found = near.join(sorted_side(onward), "near", "left").select("node", "old", F.least("near", F.coalesce("far", "near")).alias("label"))
        found = stored(found, "component-labels")
        freed(held)
        held, labels = found, found.select("node", "label")
        if found.filter("label <> old").isEmpty():
            freed(both)
            return labels
