"""Scores of clusters against ground truth by counts of pairs, and checks of ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS_AT = 0.97


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def pair_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """``tp``, ``fp``, ``fn`` by ``keys`` for rows of members with their ``truth`` and ``predicted`` cluster.

    Pairs are counted by the sizes of clusters and of their overlaps; none are formed. A member without a cluster on
    one side (null) is alone there.
    """
    key = list(keys)
    both = rows.where("truth is not null and predicted is not null").groupBy(*key, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: rows.where(F.col(c).isNotNull()).groupBy(*key, c).agg(F.count(F.lit(1)).alias("n"))
    total = lambda df, name: df.groupBy(*key).agg(F.sum(_pairs(F.col("n"))).cast("long").alias(name))
    every = rows.select(*key).distinct() if key else rows.sparkSession.range(1).select(F.lit(0).alias("_one"))
    parts = [total(both, "tp"), total(of("predicted"), "p"), total(of("truth"), "t")]
    for part in parts:
        every = every.join(part, key, "left") if key else every.join(part.withColumn("_one", F.lit(0)), "_one", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return every.select(*key, zero("tp").alias("tp"), (zero("p") - zero("tp")).alias("fp"), (zero("t") - zero("tp")).alias("fn"))


def scores(counts: DataFrame, digits: int | None = 4, pass_at: float = PASS_AT) -> DataFrame:
    """Precision, recall, F1 and whether F1 passes, judged before rounding. Without pairs precision and recall are 1."""
    tp = F.col("tp")
    share = lambda other: F.when(tp + F.col(other) == 0, F.lit(1.0)).otherwise(tp / (tp + F.col(other)))
    p, r = share("fp"), share("fn")
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return counts.withColumns({"precision": shown(p), "recall": shown(r), "f1": shown(f1), "passed": f1 >= pass_at})


def logic_ids(logic: DataFrame) -> DataFrame:
    """``rule_id``, ``raw_log`` and the id of its logic group; the last group that has a log holds it."""
    rows = logic.where("group_type = 'logic'").select("pos", "rule_id", "group_id", F.explode("original_logs").alias("raw_log"))
    return rows.groupBy("rule_id", "raw_log").agg(F.max_by("group_id", "pos").alias("group_id"))


def predicted_members(found: DataFrame, logic: DataFrame) -> DataFrame:
    """``rule_id``, ``group_id`` and the ``predicted`` cluster of each; logs that no logic group has are left out."""
    rows = found.select(F.col("pos").alias("predicted"), "rule_id", F.explode("original_logs").alias("raw_log"))
    return rows.join(logic_ids(logic), ["rule_id", "raw_log"]).select("rule_id", "group_id", "predicted").distinct()


def evaluate(truth: DataFrame, found: DataFrame, logic: DataFrame, pass_at: float = PASS_AT) -> DataFrame:
    """Scores of each rule of the ``truth`` (``rule_id``, ``cluster``, ``group_id``); other rules are left out."""
    rules = truth.select("rule_id").distinct()
    predicted = predicted_members(found, logic).join(rules, "rule_id", "left_semi")
    rows = truth.withColumnRenamed("cluster", "truth").join(predicted, ["rule_id", "group_id"], "full")
    return scores(pair_counts(rows, "rule_id"), pass_at=pass_at)


def truth_problems(truth: DataFrame, logic: DataFrame, most: int = 10) -> DataFrame:
    """``problem`` and ``group_id``: ids that are twice in the truth, missing from it, or unknown to the logic groups.

    Of missing ids the first ``most`` are told.
    """
    known = logic.where("group_type = 'logic'").select("group_id").distinct()
    twice = truth.groupBy("group_id").count().where("count > 1").select(F.lit("duplicate").alias("problem"), "group_id")
    missing = known.join(truth, "group_id", "left_anti").orderBy("group_id").limit(most).select(F.lit("missing").alias("problem"), "group_id")
    unknown = truth.select("group_id").distinct().join(known, "group_id", "left_anti").select(F.lit("unknown").alias("problem"), "group_id")
    return twice.unionByName(missing).unionByName(unknown)


def annotated_pairs(pairs: DataFrame, truth: DataFrame, eps: float) -> DataFrame:
    """Pairs (``i``, ``j``, ``dist``) by distance, with whether they merge and whether the truth (``gid``, ``cluster``)
    has them together; what the truth lacks is together with nothing."""
    side = lambda c: truth.select(F.col("gid").alias(c), F.col("cluster").alias(f"cluster_{c}"))
    known = pairs.join(side("i"), "i", "left").join(side("j"), "j", "left")
    same = F.coalesce(F.col("cluster_i") == F.col("cluster_j"), F.lit(False))
    return known.select("i", "j", F.round("dist", 6).alias("dist"), (F.col("dist") <= eps).alias("merge"), same.alias("gt_same_cluster"))


def leaf_thresholds(pairs: DataFrame, min_eps: float = 0.001, digits: int = 3) -> DataFrame:
    """``leaf`` and ``eps`` for pairs with their ``leaf``, ``label`` (1: one cluster) and ``dist``.

    Between the distances of the two labels if they can be told apart; else by the label of most pairs.
    """
    stats = pairs.groupBy("leaf").agg(
        F.max(F.when(F.col("label") == 1, F.col("dist"))).alias("far"), F.min(F.when(F.col("label") == 0, F.col("dist"))).alias("near"),
        F.avg(F.col("label").cast("double")).alias("share"),
    )
    far, near = F.col("far"), F.col("near")
    half = F.greatest(F.lit(min_eps), near * 0.5)
    eps = F.when(near.isNull(), far).when(far.isNull(), half).when(far < near, (far + near) / 2).when(F.col("share") >= 0.5, far).otherwise(half)
    return stats.select("leaf", F.greatest(F.lit(min_eps), F.round(eps, digits)).alias("eps"))
