"""Distributed connected components: least labels spread over links, with jumps to a label's own label.

Nothing but one count a round comes to the driver. Each round is written to the shared folder, which cuts its
lineage, and the round before is deleted then. Least labels combine on the map side. Up to BROADCAST_NODES labels go to
all tasks; beyond that a hub's links meet in one join key, which adaptive execution splits, since the other side has one
row for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage_table

#: Labels up to so many rows (two nodes each, some 100 bytes) are broadcast.
BROADCAST_NODES = 100_000


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node in links (a, b), whose type must have an order.

    Null ends and links of a node to itself connect nothing, though such a node is returned. No links, no rows.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = links.union(links.select("b", "a")).distinct().toDF("node", "other")
    both = stage_table(both, "links")
    table = stage_table(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("component")), "labels")
    labels = table
    few = F.broadcast if labels.count() <= BROADCAST_NODES else (lambda df: df)  # the number of nodes never changes
    while True:
        # The least label among the neighbours of a node and itself, then the label of that label.
        near = both.join(few(labels.toDF("other", "label")), "other").groupBy("node").agg(F.min("label").alias("label"))
        joined = labels.join(few(near), "node").select("node", F.col("component").alias("old"), F.least("component", "label").alias("component"))
        jumped = joined.join(few(labels.toDF("component", "further")), "component", "left")
        step = jumped.select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        step = stage_table(step, "labels")
        changed = step.filter("old <> component").limit(1).count()
        drop(table)
        table, labels = step, step.select("node", "component")
        if not changed:
            drop(both)
            return labels
