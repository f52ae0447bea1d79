"""Exact deduplication against a persistent digest index.

The index is a Spark table bucketed and sorted by digest. A batch is reduced to one row per digest, the new digests are
found by an anti-join on the bucketing key and appended; the batch's rows then look up the row that stays, those of large
groups in a broadcast table of bounded size. Only digests and ids are shuffled, never texts.

Defined cases: a null text counts as empty; a null ``doc_id`` sorts after every other id and stays only if its text has
no row with an id; of rows repeated with the same id and text exactly one stays; an empty batch gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_groups, shuffle_partitions, table, text_or_empty

WHITE_SPACE = r"[\x20\x09-\x0D]+"
INDEX_SCHEMA = "digest binary, keep_id long"


def digest(column: str = "text"):
    """SHA-256 of the text with every run of ASCII white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(column), WHITE_SPACE, " "), 256))


class DigestIndex:
    """A table ``(digest, keep_id)`` in ``buckets`` buckets by digest, each file sorted by digest.

    ``buckets`` is fixed when the table is made; about 100 million digests a bucket are fine.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets or shuffle_partitions(spark)
        if not spark.catalog.tableExists(name):
            self._append(spark.createDataFrame([], INDEX_SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.select("digest", "keep_id").repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Add ``batch (doc_id, digest)``; returns one row per row of it: doc_id, digest, keep_id, group_size, kept, copies.

        ``group_size`` counts the batch's rows, ``copies`` those with the id too; ``keep_id`` may be of an earlier batch.
        """
        rows = cut(batch.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")))
        groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("rows"))
        self._append(groups.join(self.read(), "digest", "left_anti").withColumnRenamed("first_id", "keep_id"))
        held = cut(groups.join(self.read(), "digest").select("digest", "keep_id", "group_size", "rows"))
        found = join_groups(rows, held, "digest", "rows").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
        return found.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"), "copies")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Decisions for every row of ``docs (doc_id, text)`` against ``index`` (without one, a new one that is dropped again)."""
    held = index or DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex[:12]}")
    out = held.add(docs.select("doc_id", digest().alias("digest")))
    if index is None:
        docs.sparkSession.sql(f"DROP TABLE {held.name}")
    return out


def keep_first(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    kept = exact_dedup(docs, index).where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "copies")
    seen = docs.withColumn("_own_digest", digest())
    same = seen["doc_id"].eqNullSafe(kept["_id"]) & (seen["_own_digest"] == kept["_digest"])
    single = seen.join(kept.where("copies = 1"), same, "left_semi").select(*docs.columns)
    # Of rows with one id and text any one stays; tasks reduce theirs before they meet, so many of them are no burden.
    again = seen.join(kept.where("copies > 1"), same, "left_semi")
    one = again.groupBy("doc_id", "_own_digest").agg(F.any_value(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(one.select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""
