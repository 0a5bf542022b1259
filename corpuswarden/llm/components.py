"""Connected components of links, by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuswarden.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node reached.

    Each round a node takes the smallest label among its neighbours' and its own, then
    the label of that label, so paths shrink by more than half. Sums over neighbours
    combine before their shuffle, and no neighbour list is ever collected. It ends when
    no label changes.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = durable(labels.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = durable(hooked.join(jump, "root", "left").select(
            "node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
