"""Connected components of an edge table, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v long, without nulls; loops and repeats are harmless) -> (node, component): the smallest node that each can reach.

    Least-label propagation with pointer jumping, so that chains take logarithmically many rounds. Each round is written to the
    shared folder. An empty edge table gives an empty result.
    """
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels.node == near.u).select("node", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("above"))
        nxt = written(hooked.join(roots, hooked.new == roots.root).select("node", F.least("new", "above").alias("component"), "old"), "labels")
        moved = not nxt.where("component <> old").isEmpty()
        drop(labels)
        labels = nxt
        if not moved:
            drop(both)
            out = labels.select("node", "component")
            out._marlstone_path = labels._marlstone_path
            return out
