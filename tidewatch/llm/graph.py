"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Each round takes the smallest label among the neighbours and then the label of
    that label, so paths shorten by more than half; it ends when no label changes.
    All joins are on a node with one row on one side, which adaptive execution can
    split when a hub has many edges. No edges give no rows; self-loops and repeated
    edges change nothing; rows with a null end are dropped.
    """
    links = edges.select("a", "b").where("a is not null and b is not null")
    links = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        took = labels.join(near, labels.node == near.a, "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = took.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        step = took.join(up, took.label == up.via, "left").select("node", F.least("label", "jump").alias("label"), "old")
        step = cut(step)
        discard(labels)
        labels = step
        if not step.where("label < old").limit(1).count():
            discard(links)
            return step.select("node", F.col("label").alias("component"))
