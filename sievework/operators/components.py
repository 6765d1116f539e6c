"""Connected components. With one member as the least cluster size, density clustering by a threshold is just this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.storage import store


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for the ends of ``edges`` (``a``, ``b``: longs).

    Each round hooks every node to its smallest neighbour, if smaller, and to that one's in turn, then contracts the
    edges. Components at least halve in each round, and rounds are stored.
    """
    edges = store(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    labels = store(labels, "labels")
    while not edges.isEmpty():
        turned = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = store(turned.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "hooks")
        twice = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hooks = store(hooks.join(twice, "up").select("node", "top"), "hooks")
        end = lambda c: hooks.select(F.col("node").alias(c), F.col("top").alias(f"{c}_top"))
        drawn = edges.join(end("a"), "a").join(end("b"), "b").where("a_top <> b_top")
        edges = store(drawn.select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).distinct(), "edges")
        labels = store(labels.join(end("component"), "component", "left").select("node", F.coalesce("component_top", "component").alias("component")), "labels")
    return labels


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every row of ``nodes`` (``node``) with its ``component``; a node without edges is its own."""
    return nodes.join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
