"""Readers of reports, template dictionaries, results and ground truth; the writer of results.

Paths go to Spark's readers, so any store that Spark reads will do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, MapType, StringType, StructField, StructType

from sievework.functions import text as T

STRING, LONG = StringType(), LongType()
GROUP = StructType([StructField(n, t) for n, t in (
    ("group_type", STRING), ("group_id", STRING), ("rule_id", STRING), ("representative_template", STRING), ("representative_pattern", STRING),
    ("total_count", LONG), ("merged_variants_count", LONG), ("original_logs", ArrayType(STRING)),
)])
COUNTS = StructType([StructField(n, LONG) for n in ("parsed_logs", "logic_groups", "final_groups")])
AI = StructType([StructField("enabled", BooleanType()), StructField("backend", STRING), StructField("warnings", ArrayType(STRING))])
RUN = StructType([StructField("timestamp_utc", STRING), StructField("log_file", STRING), StructField("template_file", STRING), StructField("sanity_item", STRING), StructField("counts", COUNTS), StructField("ai", AI)])
RESULTS = StructType([StructField("schema_version", LONG), StructField("run", RUN), StructField("groups", ArrayType(GROUP))])
TRUTH = MapType(STRING, ArrayType(ArrayType(STRING)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no`` (in the order of the file) and ``value``. Files are split as Spark sees fit.

    The number is the line's place among the rows of its split added to the split's offset in bytes, which is more than
    the lines before it. So it orders lines, though it isn't dense. Bytes that aren't UTF-8 are dropped.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    own = F.monotonically_increasing_id()
    numbered = raw.withColumn("_row", own)
    first = numbered.groupBy("file", "_block").agg(F.min("_row").alias("_first"))
    return numbered.join(first, ["file", "_block"]).select("file", (F.col("_block") + F.col("_row") - F.col("_first")).alias("line_no"), F.replace("value", F.lit("�"), F.lit("")).alias("value"))


def read_dictionary(spark: SparkSession, path: str | None) -> DataFrame:
    """``rule_id``, ``message``, ``line_no`` of a template file; none if there is no file."""
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], "rule_id string, message string, line_no long")
    lines = read_lines(spark, path).withColumn("value", T.strip(F.col("value")))
    kept = lines.where((F.col("value") != "") & ~F.col("value").rlike("^(-|Rule|Severity)"))
    part = lambda k: F.regexp_extract("value", T.DU + r"^(\S+)\s+\S+\s+\S+\s+(.*)$", k)
    return kept.select(part(1).alias("rule_id"), part(2).alias("message"), "line_no").where("rule_id <> ''")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def require_readable(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        if not _exists(spark, path):
            raise FileNotFoundError(f"input file not found: {path}")


def read_results(spark: SparkSession, path: str) -> tuple[dict | None, DataFrame]:
    """The run's description (None for the old list form) and the groups with their place ``pos``."""
    text = spark.read.text(path, wholetext=True)
    head = text.select(F.substring(F.ltrim("value"), 1, 1)).first()
    if head is None or head[0] not in ("{", "["):
        raise ValueError("results must be a JSON object or a list")
    if head[0] == "[":
        groups = text.select(F.posexplode(F.from_json("value", ArrayType(GROUP))).alias("pos", "g"))
        return None, groups.select("pos", "g.*")
    parsed = text.select(F.from_json("value", RESULTS).alias("r"))
    top = parsed.select("r.schema_version", F.to_json("r.run").alias("run"), (F.col("r.groups").isNotNull()).alias("listed")).first()
    if top["schema_version"] != 2 or top["run"] is None or not top["listed"]:
        raise ValueError("results of version 2 need schema_version, run and groups")
    return json.loads(top["run"]), parsed.select(F.posexplode("r.groups").alias("pos", "g")).select("pos", "g.*")


def write_results(groups: DataFrame, run: dict, path: str, indent: int = 2) -> None:
    """One JSON document at ``path``: the run and the groups by ``seq``. Keys without a value are left out of the run.

    The document is a report for reading, and is as large as what ``original_logs`` keeps; :func:`write_group_table` is
    the form without that bound.
    """
    spark = groups.sparkSession
    rows = [r.asDict(True) for r in groups.orderBy("seq").select(*GROUP.names).toLocalIterator()]
    body = {"schema_version": 2, "run": {k: v for k, v in run.items() if v is not None or k == "ai"}, "groups": rows}
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(body, ensure_ascii=False, indent=indent).encode()))
    finally:
        out.close()


def write_group_table(groups: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").parquet(path)


def run_description(log_file: str, counts: dict, backend: str | None, warnings: list[str], **optional: str | None) -> dict:
    from datetime import UTC, datetime

    told = {"timestamp_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "log_file": log_file}
    told |= {k: v for k, v in optional.items() if v is not None}
    return told | {"counts": counts, "ai": {"enabled": backend is not None, "backend": backend, "warnings": warnings}}


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``rule_id``, ``cluster`` and ``group_id`` of a ground truth file."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", TRUTH).alias("t"))
    if text.where("t is null").count():
        raise ValueError("ground truth must be a JSON object of lists")
    rules = text.select(F.explode("t").alias("rule_id", "clusters"))
    return rules.select("rule_id", F.posexplode("clusters").alias("cluster", "ids")).select("rule_id", F.col("cluster").cast("long"), F.explode("ids").alias("group_id"))


def first_groups(groups: DataFrame, top: int, order: str = "seq") -> DataFrame:
    return groups.orderBy(order).limit(max(0, top))


