"""Connected components of a graph that no machine holds: smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.llm.io import forget, stored

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) of every node of links (a, b).

    Rounds are written to the shared folder; a hub's links are pre-aggregated before the shuffle."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("w")).union(links.select("b", "a")).filter("u <> w").distinct())
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("w"), F.first("u")).alias("comp")))
    held = labels
    for _ in range(MOST_ROUNDS):
        near = edges.join(labels, edges["w"] == labels["node"]).groupBy("u").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("comp").alias("before"), F.least("comp", "near").alias("comp"))
        jump = step.select(F.col("node").alias("at"), F.col("comp").alias("further"))
        after = stored(step.join(jump, step["comp"] == jump["at"], "left").select("node", "before", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        moved = after.filter("before <> comp").limit(1).count()
        forget(held)
        labels, held = after.select("node", "comp"), after
        if not moved:
            forget(edges)
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
