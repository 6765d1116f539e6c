"""Deterministic grouping of records, ranking, and the groups' output form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.storage import ranked


def logic_groups(records: DataFrame) -> DataFrame:
    """``rule_id``, ``pattern``, ``template`` with the number of records and the first line. Severity is no key."""
    keyed = records.select("rule_id", T.signature(F.col("variables")).alias("pattern"), "template", "line_no")
    return keyed.groupBy("rule_id", "pattern", "template").agg(F.count(F.lit(1)).alias("total_count"), F.min("line_no").alias("first_seen"))


def membership(records: DataFrame) -> DataFrame:
    """Each record with its group's key."""
    return records.withColumn("pattern", T.signature(F.col("variables")))


def ranked_groups(groups: DataFrame) -> DataFrame:
    """Groups by falling count, then first line, with their place ``seq``."""
    order = [F.desc("total_count"), F.asc("first_seen"), F.asc("rule_id"), F.asc("pattern"), F.asc("template")]
    return ranked(groups, order)


def original_logs(records: DataFrame, most: int = 0) -> DataFrame:
    """The raw logs of each group in order, the first ``most`` of them (0: all).

    With a limit, only that many rows of a group are gathered.
    """
    rows = membership(records).select("rule_id", "pattern", "template", "line_no", "raw_log")
    if most > 0:
        place = F.row_number().over(Window.partitionBy("rule_id", "pattern", "template").orderBy("line_no"))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    kept = rows.groupBy("rule_id", "pattern", "template").agg(F.sort_array(F.collect_list(F.struct("line_no", "raw_log"))).alias("logs"))
    return kept.select("rule_id", "pattern", "template", F.transform("logs", lambda x: x["raw_log"]).alias("original_logs"))


def output_groups(groups: DataFrame, records: DataFrame | None = None, most: int = 0) -> DataFrame:
    """Ranked groups in the results schema; ``seq`` keeps their order."""
    top = ranked_groups(groups)
    logs = original_logs(records, most) if records is not None else None
    full = top.join(logs, ["rule_id", "pattern", "template"], "left") if logs is not None else top.withColumn("original_logs", F.array().cast("array<string>"))
    return full.select(
        F.lit("logic").alias("group_type"), F.format_string("%s::logic::%06d", F.col("rule_id"), F.col("seq")).alias("group_id"), "rule_id",
        F.col("template").alias("representative_template"), F.col("pattern").alias("representative_pattern"), "total_count",
        F.lit(1).cast("long").alias("merged_variants_count"), "original_logs", "seq",
    )
