"""Clusters of groups as super groups: counts, a representative, a merged pattern, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.storage import ranked


def merged_patterns(patterns: DataFrame) -> DataFrame:
    """``component`` and ``merged`` for the patterns (``component``, ``ord``, ``pattern``) of each component.

    Slots are merged one by one: equal numbers of segments are merged segment by segment with up to 4 alternatives,
    others as a whole with up to 6; more become ``*``. Values are told apart before they are gathered, and only as many
    as may be shown are gathered, so a component of any size takes little room.
    """
    count = patterns.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min_by("pattern", "ord").alias("only"))
    told = patterns.where((F.col("pattern") != "") & (F.col("pattern") != T.NO_VARIABLE))
    cut = told.select("component", "ord", F.posexplode(T.slots(F.col("pattern"))).alias("slot", "value"))
    widths = cut.groupBy("component").agg(F.max("slot").alias("last"))
    value = T.strip(F.col("value"))
    ends = F.substring(value, 1, 1)
    quoted = (F.length(value) >= 2) & ends.isin("'", '"') & value.endswith(ends)
    shaped = cut.where(F.col("value") != T.NO_VARIABLE).select("component", "slot", "ord", F.when(quoted, ends).alias("quote"), F.when(quoted, F.expr("substring(trim(value), 2, length(trim(value)) - 2)")).otherwise(value).alias("core"))
    quotes = shaped.groupBy("component", "slot").agg(F.count_distinct("quote").alias("kinds"), F.min("quote").alias("quote"))
    cores = shaped.groupBy("component", "slot", "core").agg(F.min("ord").alias("ord")).withColumn("parts", F.split("core", "/"))
    shape = cores.groupBy("component", "slot").agg(F.count(F.lit(1)).alias("cores"), F.min(F.size("parts")).alias("low"), F.max(F.size("parts")).alias("high"))
    known = cores.join(shape, ["component", "slot"])
    even = (F.col("low") == F.col("high")) & (F.col("cores") > 1)
    pieces = F.when(even, F.col("parts")).otherwise(F.array("core"))
    most = F.when(even, T.MERGE_SEGMENT).otherwise(T.MERGE_SLOT)
    values = known.select("component", "slot", "ord", most.alias("most"), F.posexplode(pieces).alias("segment", "atom"))
    values = values.groupBy("component", "slot", "segment", "most", "atom").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("component", "slot", "segment").orderBy("ord", "atom"))
    few = values.withColumn("place", place).where(F.col("place") <= F.greatest(F.lit(T.MERGE_SEGMENT), F.lit(T.MERGE_SLOT)) + 1)
    atoms = few.groupBy("component", "slot", "segment", "most").agg(F.sort_array(F.collect_list(F.struct("place", "atom"))).alias("a"))
    shown = F.transform("a", lambda x: x["atom"])
    atom = F.when(F.size("a") == 1, F.get(shown, F.lit(0))).when(F.size("a") <= F.col("most"), F.concat(F.lit("{"), F.array_join(shown, "|"), F.lit("}"))).otherwise("*")
    joined = atoms.withColumn("atom", atom).groupBy("component", "slot").agg(F.sort_array(F.collect_list(F.struct("segment", "atom"))).alias("s"))
    core = F.array_join(F.transform("s", lambda x: x["atom"]), "/")
    quote = F.when(F.col("kinds") == 1, F.col("quote")).otherwise("")
    slot = joined.join(quotes, ["component", "slot"]).select("component", "slot", F.concat(quote, core, quote).alias("text"))
    every = widths.select("component", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("slot")).join(slot, ["component", "slot"], "left")
    whole = every.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("text", F.lit(T.NO_VARIABLE)).alias("text")))).alias("t"))
    whole = whole.select("component", F.array_join(F.transform("t", lambda x: x["text"]), " / ").alias("merged"))
    return count.join(whole, "component", "left").select("component", F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("merged", F.lit(T.NO_VARIABLE))).alias("merged"))


def super_groups(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row per cluster of groups (``rule_id``, ``gid``, ``template``, ``pattern``, ``total_count``; the order of
    ``gid`` breaks ties): counts, the template of its largest group, its merged pattern."""
    placed = groups.join(clusters.select("gid", "component"), "gid")
    counts = placed.groupBy("rule_id", "component").agg(
        F.sum("total_count").alias("total_count"), F.count(F.lit(1)).alias("merged_variants_count"),
        F.min_by("template", F.struct(-F.col("total_count"), F.col("gid"))).alias("representative_template"),
    )
    merged = merged_patterns(placed.select("component", F.col("gid").alias("ord"), "pattern"))
    return counts.join(merged, "component").withColumnRenamed("merged", "representative_pattern")


def output_super_groups(supers: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Super groups in the results schema, by falling count, then first group; ``logs`` has ``component``, ``gid`` and
    ``original_logs``."""
    top = ranked(supers, [F.desc("total_count"), F.asc("component")])
    if logs is not None:
        gathered = logs.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("gid", "original_logs"))).alias("l"))
        top = top.join(gathered.select("component", F.flatten(F.transform("l", lambda x: x["original_logs"])).alias("original_logs")), "component", "left")
    else:
        top = top.withColumn("original_logs", F.array().cast("array<string>"))
    return top.select(F.lit("ai_super").alias("group_type"), F.format_string("%s::ai::%06d", F.col("rule_id"), F.col("seq")).alias("group_id"), "rule_id", "representative_template", "representative_pattern", "total_count", "merged_variants_count", "original_logs", "seq")
