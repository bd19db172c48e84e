"""Connected components of a link table: least labels of neighbours, then labels of labels, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.staging import Stages


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """node and the least node of its component, for every node of `links` (a, b).

    Each round reads and writes staged tables; only the number of changed labels reaches the driver. A label
    drops to the least one among the neighbours and then to that one's own label, so distances halve.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    edges = stages.put(both.distinct())
    labels = stages.put(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        hooked = stages.put(
            labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower"))
        )
        jumped = stages.put(
            hooked.alias("h").join(hooked.alias("t"), F.col("h.lower") == F.col("t.node"))
            .select("h.node", F.col("t.lower").alias("label"), (F.col("t.lower") != F.col("h.label")).alias("changed"))
        )
        stages.drop(labels)
        stages.drop(hooked)
        labels = jumped
        if not labels.filter("changed").limit(1).count():
            return labels.select("node", "label")
