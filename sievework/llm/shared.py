"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.storage import discard, fresh_path, release
from sievework.storage import store as materialize

__all__ = ["BATCH_ROWS", "SPACE_CLASS", "WORD_PATTERN", "discard", "documents", "fresh_path", "materialize", "partitions", "release", "remove", "small_batches", "table"]

#: White space of every contract of this subpackage: space and \x09-\x0D, nothing else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; keeps a batch of long texts within a worker's memory.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that an Arrow batch brings to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; columns of other names can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete the files at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
