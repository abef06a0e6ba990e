"""Connected components by least-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the component's least node.

    Every round is a written table, so lost executors cost one round at most.
    Messages to a node are combined before they are shuffled, and both sides
    of each join are plain tables, which lets Spark split a hub's partition.
    """
    both = space.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-both")
    labels = space.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), f"{name}-0")
    rounds = 0
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels.node == heard.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        nearer = space.keep(nearer, f"{name}-{rounds}-near")
        above = nearer.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = space.keep(nearer.join(above, "label").select("node", "old", F.col("top").alias("label")), f"{name}-{rounds + 1}")
        space.drop(f"{name}-{rounds}", f"{name}-{rounds}-near")
        rounds += 1
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            space.drop(f"{name}-both")
            return labels
