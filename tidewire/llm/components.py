"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node in ``links`` (a, b).

    Each round hands every node the smallest label among its neighbours, then the
    label of that label, so long chains shrink fast. Labels of a hub are gathered by
    partial aggregation; rounds are written, so none is computed again.
    """
    both = written(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = written(labels, "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = written(
            lower.join(jump, "label", "left").select(
                "node", "before", F.least("label", F.coalesce("further", "label")).alias("label")
            ),
            "labels",
        )
        if not stepped.where(F.col("before") != F.col("label")).take(1):
            return stepped.select("node", F.col("label").alias("component"))
        labels = stepped.select("node", "label")
