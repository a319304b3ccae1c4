"""Connected components of a table of links, by minimum labels and pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (a, b). Returns (node, component): every node of a link with the smallest node that links reach.

    A round takes the smallest label among neighbours and then the label of the label, so a chain of n links needs about log n
    rounds; minima are pre-aggregated before the shuffle, so a hub costs one row a task. Raises if max_rounds do not suffice."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        new = written(low.join(up, "low", "left").select("node", "old", F.least("low", F.coalesce("up", "low")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where(F.col("old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError(f"components: {max_rounds} rounds do not suffice")
