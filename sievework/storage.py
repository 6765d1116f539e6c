"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}
#: Spark's setting by which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="sievework-"))


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/sievework/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` and read it back: cuts lineage, and fixes what isn't deterministic, such as partition numbers.

    The files outlive lost executors, so nothing before them is computed twice. What was shuffled to make them is of no
    use once they are written, and goes at once.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete the files of a table, or of a union of tables, that ``store`` returned; nothing may read it afterwards."""
    spark = stored.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what this application stored; call it when its results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/sievework/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """``df`` with its 1-based place in a total ``order``, without bringing the rows into one task.

    Rows are dealt out by ranges of the order and numbered within each range; what a range starts from is summed over
    one row per range.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    stored = store(dealt, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return stored.withColumn(name, within).join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")
