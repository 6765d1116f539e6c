"""Exact deduplication over a persistent digest index.

Two texts are equal if they are the same after all white space is deleted. The index is a table bucketed and sorted by
the SHA-256 of that form, with one row per digest: the row that stays, its length and the number of rows it stands for.
New rows are reduced to one per digest; a sort-merge anti-join, without an exchange on the index's side, tells those
whose digest the index lacks, and these are appended under the same bucketing. Of the others only the counts and the
better rows are new: they go to a second table of the same bucketing, which is merged in, again without an exchange,
when the index is read. So an index fed batch by batch says what one fed at once does.

Results for odd input: a null text counts as empty; of equal texts the longest, then the one with the smallest
``doc_id`` stays, and a null ``doc_id`` only if its group has no other; every copy of a repeated row is counted, and
each copy of the row that stays is marked as kept. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.shared import SPACE_CLASS, documents, fresh_path, materialize, partitions, remove

#: A digest with over a HOT_PART-th of all rows is joined by broadcast; there are fewer than HOT_PART of them.
HOT_PART = 256
#: Appends by which ``dedup`` feeds a table to the index.
APPENDS = 2
COLUMNS = ("digest", "keep_id", "n_points", "group_size")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_points`` (code points of the original text) and the ``digest`` of the text without white space."""
    bare = F.regexp_replace("text", SPACE_CLASS + "+", "")
    return documents(docs).select("doc_id", F.length("text").cast("long").alias("n_points"), F.unhex(F.sha2(bare, 256)).alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest. Counts and maxima are formed before the exchange, so a large group sends a row per task."""
    return _merged(rows.select("digest", F.col("doc_id").alias("keep_id"), "n_points", F.lit(1).cast("long").alias("group_size")))


def _merged(rows: DataFrame) -> DataFrame:
    """The best row and the sum of the counts of each digest."""
    best = F.max(F.struct("n_points", (-F.col("keep_id")).alias("order")))
    return rows.groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size")).select("digest", (-F.col("best.order")).alias("keep_id"), F.col("best.n_points").alias("n_points"), "group_size")


class DigestIndex:
    """The bucketed tables at ``location``; made if absent, opened with what they have otherwise.

    With fewer buckets than shuffle partitions, Spark rather exchanges the index's side too.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None, name: str | None = None):
        self.spark, self.location, self.buckets = spark, location, buckets or partitions(spark)
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.more = f"{self.name}_more"
        for table, part in ((self.name, "first"), (self.more, "more")):
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, n_points BIGINT, group_size BIGINT) "
                f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}/{part}'"
            )

    def read(self) -> DataFrame:
        """Every digest with its best row and count over all appends."""
        later = _merged(self.spark.table(self.more)).select("digest", F.struct("n_points", (-F.col("keep_id")).alias("order")).alias("later"), F.col("group_size").alias("added"))
        both = self.spark.table(self.name).join(later.hint("merge"), "digest", "left")
        best = F.greatest(F.struct("n_points", (-F.col("keep_id")).alias("order")), F.col("later"))
        return both.select("digest", best.alias("best"), (F.col("group_size") + F.coalesce("added", F.lit(0))).alias("group_size")).select("digest", (-F.col("best.order")).alias("keep_id"), F.col("best.n_points").alias("n_points"), "group_size")

    def unseen(self, new: DataFrame) -> DataFrame:
        """The rows of ``new``, one per digest, whose digest the index lacks."""
        return new.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame) -> None:
        """Add ``new``, one row per digest: unseen digests to the index, counts and rows of the others to what is merged in."""
        new = materialize(new, "new-digests")
        fresh = materialize(self.unseen(new), "fresh-digests")
        known = new.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_semi")
        known = materialize(known, "known-digests")
        for rows, table in ((fresh, self.name), (known, self.more)):
            (
                rows.select(*COLUMNS).repartition(self.buckets, "digest")
                .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)
            )
            self.spark.catalog.refreshTable(table)

    def drop(self) -> None:
        """Take the tables out of the catalog and delete their files."""
        for table in (self.name, self.more):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, self.location)


def dedup(docs: DataFrame, index: DigestIndex | None = None, appends: int = APPENDS) -> DataFrame:
    """Every row of ``docs`` with the row of its group that stays, after adding ``docs`` to the index, in ``appends`` parts.

    Groups are those of all that the index was ever fed. Without an ``index`` one is made and dropped.
    """
    spark = docs.sparkSession
    rows = materialize(digests(docs), "digests")
    own = DigestIndex(spark, fresh_path(spark, "digest-index")) if index is None else index
    part = F.pmod(F.xxhash64("doc_id"), F.lit(appends))
    for k in range(appends):
        own.append(winners(rows.where(part == k)))
    kept = own.read().select("digest", "keep_id", "group_size")
    share = rows.agg((F.count(F.lit(1)) / HOT_PART).alias("n")).first()["n"]
    hot = F.broadcast(kept.where(F.col("group_size") > share).join(_hot(rows, share), "digest").select("digest", "keep_id", "group_size"))
    marked = rows.join(hot, "digest", "left")
    few = marked.where(F.col("group_size").isNull()).select("digest", "doc_id").join(kept, "digest")
    columns = ("doc_id", "keep_id", "group_size", "digest")
    both = marked.where(F.col("group_size").isNotNull()).select(*columns).unionByName(few.select(*columns))
    done = both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if index is None:
        done = materialize(done, "exact-dedup")
        own.drop()
    return done


def _hot(rows: DataFrame, share: float) -> DataFrame:
    """The digests with over ``share`` of these rows, fewer than HOT_PART whatever the index holds."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("digest")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
