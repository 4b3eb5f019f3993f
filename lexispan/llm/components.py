"""Connected components of a link table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import dropped, moved, stored


def least_labels(links: DataFrame, label: str) -> DataFrame:
    """node, component (least node reachable) for every node of ``links`` (columns a, b).

    Every round each node takes the least label among its neighbours' and its own, then
    the label of that label; rounds grow with the logarithm of a component's width. Each
    round's table is written to the shared folder, so that the plan stays short."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, f"{label}-links")
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")),
        f"{label}-labels",
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        after = stored(
            lower.join(jump, "component", "left").select(
                "node", "before", F.least("component", F.coalesce("beyond", "component")).alias("component")
            ),
            f"{label}-labels",
        )
        done = after.where("before != component").isEmpty()
        dropped(labels)
        labels = after
        if done:
            dropped(both)
            return moved(labels, labels.select("node", "component"))
