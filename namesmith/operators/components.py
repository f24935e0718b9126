"""Connected components of a match graph by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesmith.plans.storage import cut, remove


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Each round a node takes the least label among its neighbours' and then its
    label's label, so long chains shrink by jumps. Rounds are cut by written
    tables. Nulls, self-loops and repeated edges don't matter; no edges, no rows.
    """
    links = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    links = cut(links.union(links.select("b", "a")).distinct(), "links")
    labels = cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("component").alias("jump"))
        last, labels = labels, cut(step.join(up, "new").select("node", "old", F.least("new", "jump").alias("component")), "labels")
        remove(last)
        if labels.where("old <> component").isEmpty():
            remove(links)
            return labels.select("node", "component")
