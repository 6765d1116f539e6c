"""Which levels of paths tell clusters apart, and which only vary within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T


def level_values(paths: DataFrame) -> DataFrame:
    """``var``, ``level``, ``gid``, ``value`` for paths (``var``, ``gid``, ``path``); a path too short has the value ''."""
    cut = paths.select("var", "gid", T.path_parts(F.col("path")).alias("parts"))
    deepest = cut.groupBy("var").agg(F.max(F.size("parts")).alias("depth"))
    every = cut.join(deepest, "var").where("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    return every.select("var", "depth", "level", "gid", F.coalesce(F.get("parts", F.col("level")), F.lit("")).alias("value"))


def level_signals(paths: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """``var``, ``depth``, ``level``, ``n_unique`` and ``signal``: ``noise`` if a cluster has several values, ``signal``
    if clusters differ, else ``constant``; ``unknown`` if values differ and no cluster is known."""
    values = level_values(paths)
    unique = values.groupBy("var", "depth", "level").agg(F.count_distinct(F.when(F.col("value") != "", F.col("value"))).alias("n_unique"))
    if truth is None:
        return unique.withColumn("signal", F.when(F.col("n_unique") > 1, "unknown").otherwise("constant"))
    by_cluster = values.join(truth.select("gid", "cluster"), "gid").groupBy("var", "level", "cluster").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    told = by_cluster.groupBy("var", "level").agg(F.max("n").alias("within"), F.count_distinct("value").alias("between"))
    kind = F.when(F.col("n_unique") <= 1, "constant").when(F.col("within").isNull(), "unknown").when(F.col("within") > 1, "noise").when(F.col("between") > 1, "signal").otherwise("constant")
    return unique.join(told, ["var", "level"], "left").select("var", "depth", "level", "n_unique", kind.alias("signal"))


def recommendations(signals: DataFrame) -> DataFrame:
    """``var`` and ``recommendation``, a hint for its levels, counted from the end; null where none is needed."""
    level = lambda kind: F.sort_array(F.collect_list(F.when(F.col("signal") == kind, F.col("level") - F.col("depth"))))
    many = (F.col("n_unique") > F.col("depth"))
    at = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("level") - F.col("depth"))))
    found = signals.groupBy("var").agg(level("signal").alias("good"), level("noise").alias("bad"), F.max("n_unique").alias("most"), at(many).alias("high"), at(~many & (F.col("n_unique") > 1)).alias("keep"))
    show = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    hint = (
        F.when(F.col("most") <= 1, "one value everywhere: weight 0")
        .when((F.size("good") > 0) & (F.size("bad") > 0), F.concat(F.lit("take levels "), show("good"), F.lit("; within labelled clusters "), show("bad"), F.lit(" differ")))
        .when(F.size("good") > 0, F.lit(None).cast("string"))
        .when(F.size("bad") > 0, "what varies does so within labelled clusters: weight 0 may be better")
        .when((F.size("high") > 0) & (F.size("keep") > 0), F.concat(F.lit("perhaps levels "), show("keep"), F.lit("; levels "), show("high"), F.lit(" have many values")))
    )
    return found.select("var", hint.alias("recommendation"))
