"""The whole way from report lines to output groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import distance, features, rollup
from sievework.operators.config import Config
from sievework.operators.embed import Embedder
from sievework.operators.logic import logic_groups, original_logs, output_groups
from sievework.storage import ranked, store


def numbered(groups: DataFrame) -> DataFrame:
    """Groups with ``gid``, their place by falling count and first line."""
    order = [F.desc("total_count"), F.asc("first_seen"), F.asc("rule_id"), F.asc("pattern"), F.asc("template")]
    return store(ranked(groups, order, "gid").withColumn("gid", F.col("gid").cast("long")), "groups")


def group_clusters(groups: DataFrame, config: Config | None, embedder: Embedder) -> DataFrame:
    """``gid`` and ``component`` of every group. Without a configuration templates alone are compared.

    Rules with a pairwise tree take their distances from it, rules with an adaptive tree have theirs scaled by it, and
    rules with one group need none.
    """
    several = groups.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    open_ = groups.join(several, "rule_id")
    if config is None:
        near, placed = distance.linked(open_, Config(default_template_weight=1.0), embedder)
    else:
        by_tree = [r for r, x in config.rules.items() if x.pairwise_tree]
        scaled = [r for r, x in config.rules.items() if x.adaptive_eps_tree and not x.pairwise_tree]
        rest = open_.where(~F.col("rule_id").isin(by_tree + scaled)) if by_tree or scaled else open_
        near, placed = distance.linked(rest, config, embedder)
        for r in by_tree:
            rule = config.rules[r]
            near = near.unionByName(distance.joining(features.tree_pairs(open_.where(F.col("rule_id") == r), rule.pairwise_tree).where(F.col("dist") <= rule.eps)))
        for r in scaled:
            own = open_.where(F.col("rule_id") == r)
            tree = config.rules[r].adaptive_eps_tree
            greatest = max(n["value"] for n in tree.nodes if "value" in n) * (1 + 1e-9)  # no leaf merges pairs beyond it
            base = distance.pairs(distance.items(own, config, embedder), own.select("rule_id").distinct().withColumn("eps", F.lit(float(greatest))))
            near = near.unionByName(distance.joining(features.adaptive_pairs(own, base, tree).where("dist <= 1.0")))
    return distance.cluster(groups.select("gid"), near, placed)


def run(records: DataFrame, config: Config | None = None, embedder: Embedder | None = None, ai: str = "auto", most_logs: int = 0, warn: Callable[[str], None] = lambda _: None) -> tuple[DataFrame, bool]:
    """Output groups of ``records``, and whether the second stage ran.

    ``ai``: ``off`` skips it, ``on`` needs an embedder, ``auto`` takes one if there is one. If embedding fails under
    ``auto``, each group is a super group of its own.
    """
    groups = logic_groups(records)
    if ai == "on" and embedder is None:
        raise RuntimeError("the second stage was asked for, but there is no embedder")
    if ai == "off" or embedder is None:
        return output_groups(groups, records, most_logs), False
    known = numbered(groups)
    try:
        clusters = store(group_clusters(known, config, embedder), "clusters")
    except Exception as e:
        if ai == "on":
            raise RuntimeError(f"embedding failed: {e}") from e
        warn(f"embedding failed, groups stay apart: {e}")
        clusters = known.select("gid", F.col("gid").alias("component"))
    supers = rollup.super_groups(known, clusters)
    logs = original_logs(records).join(known, ["rule_id", "pattern", "template"]).join(clusters, "gid").select("component", "gid", "original_logs")
    out = rollup.output_super_groups(supers, logs)
    return (out.withColumn("original_logs", F.slice("original_logs", 1, most_logs)) if most_logs > 0 else out), True
