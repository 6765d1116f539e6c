"""From report lines to records: classification, carried context, templates and rule lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T

#: Lines of a file that one window holds.
BLOCK_LINES = 100_000


def classified(lines: DataFrame) -> DataFrame:
    """``lines`` (``file``, ``line_no``, ``value``) with the ``kind`` of each."""
    return lines.withColumn("kind", T.kind(F.col("value")))


def with_context(known: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Classified lines with the ``severity`` and ``rule_id`` in force.

    A severity line sets the severity and clears the rule, a rule line sets the rule, noise clears it. State is carried
    in two steps: what each block of a file leaves is carried over the blocks (a row for each), then lines take up from
    their block's start. So no window holds more than a block, however long the file.
    """
    value, kind = F.col("value"), F.col("kind")
    own_severity = F.when(kind == "severity", T.severity(value))
    own_rule = F.when(kind == "rule", F.struct(T.rule(value).alias("id"))).when(kind.isin("severity", "noise"), F.struct(F.lit(None).cast("string").alias("id")))
    events = known.withColumns({"_block": F.floor(F.col("line_no") / block_lines), "_severity": own_severity, "_rule": own_rule})
    ends = events.groupBy("file", "_block").agg(
        F.max_by("_severity", F.when(F.col("_severity").isNotNull(), F.col("line_no"))).alias("_severity"),
        F.max_by("_rule", F.when(F.col("_rule").isNotNull(), F.col("line_no"))).alias("_rule"),
    )
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("file", "_block", F.last("_severity", True).over(earlier).alias("_severity_before"), F.last("_rule", True).over(earlier).alias("_rule_before"))
    so_far = Window.partitionBy("file", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = events.join(starts, ["file", "_block"])
    severity = F.coalesce(F.last("_severity", True).over(so_far), F.col("_severity_before"))
    rule = F.coalesce(F.last("_rule", True).over(so_far), F.col("_rule_before"))["id"]
    return carried.withColumns({"severity": severity, "rule_id": rule}).drop("_block", "_severity", "_rule", "_severity_before", "_rule_before")


def records(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """A record for each instance line that has a rule and a severity."""
    found = with_context(classified(lines), block_lines).where("kind = 'instance' and rule_id is not null and severity is not null")
    raw = found.withColumn("raw_log", T.message(F.col("value")))
    return raw.select("file", "line_no", "severity", "rule_id", T.variables(F.col("raw_log")).alias("variables"), T.template(F.col("raw_log")).alias("template"), "raw_log")


def run_counters(lines: DataFrame) -> DataFrame:
    """One row: instances, severity sections, rule lines and skipped lines (orphans among them)."""
    known = with_context(classified(lines))
    kept = (F.col("kind") == "instance") & F.col("rule_id").isNotNull() & F.col("severity").isNotNull()
    count = lambda c, name: F.count_if(c).alias(name)
    return known.agg(count(kept, "instances"), count(F.col("kind") == "severity", "severities"), count(F.col("kind") == "rule", "rules"), count(~kept & ~F.col("kind").isin("severity", "rule"), "skipped"))


def dictionary(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``rule_id``, ``message``, ``line_no``: rules by exact message (the last entry holds) and by template.

    A template that several rules use resolves to none of them.
    """
    exact = entries.groupBy(T.strip(F.col("message")).alias("message")).agg(F.max_by("rule_id", "line_no").alias("exact_rule"))
    by_template = entries.groupBy(T.template(F.col("message")).alias("template")).agg(F.count_distinct("rule_id").alias("_n"), F.first("rule_id").alias("template_rule"))
    return exact, by_template.where("_n = 1").drop("_n")


def ambiguous_templates(entries: DataFrame) -> DataFrame:
    found = entries.groupBy(T.template(F.col("message")).alias("template")).agg(F.count_distinct("rule_id").alias("rules"))
    return found.where("rules > 1")


def resolve_rules(logs: DataFrame, entries: DataFrame) -> DataFrame:
    """``logs`` (``raw_log``) with the ``rule_id`` by exact message, else by template, else a hash of the template."""
    exact, by_template = dictionary(entries)
    shaped = logs.withColumn("template", T.template(F.col("raw_log"))).withColumn("message", T.strip(F.col("raw_log")))
    found = shaped.join(exact, "message", "left").join(by_template, "template", "left")
    return found.withColumn("rule_id", F.coalesce("exact_rule", "template_rule", T.unknown_rule(F.col("template")))).drop("exact_rule", "template_rule", "message")


def legacy_records(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Records of a plain log: every instance line, its rule from the dictionary, without a severity."""
    value = T.strip(F.col("value"))
    skipped = (value == "") | value.rlike("^(-|=|Rule|Severity)")
    logs = lines.where(~skipped).withColumn("value", value).where(F.col("value").rlike(T.DU + T.INSTANCE)).withColumn("raw_log", T.message(F.col("value")))
    return resolve_rules(logs, entries).select("file", "line_no", F.lit(None).cast("string").alias("severity"), "rule_id", T.variables(F.col("raw_log")).alias("variables"), "template", "raw_log")
