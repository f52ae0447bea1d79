"""Shared helpers: table access, lineage cuts and bounded sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_dir

__all__ = ["cut", "shared_dir"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables, read by Spark from wherever ``sf_dir`` points."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep the Arrow batches that Python tasks get small, so that very long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker; what is in it can be made anew at any time."""
    import sys
    import types

    home = sys.modules.setdefault("ledgerlark_worker_cache", types.ModuleType("ledgerlark_worker_cache"))
    return home.__dict__.setdefault(name, {})


LARGE_GROUPS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined by ``key`` with ``groups``, one row per key that has ``size`` rows; both are read more than once.

    A group of at least 1 / ``LARGE_GROUPS`` of all rows is looked up in a broadcast table, of which there can be at most so
    many, so no task gets a large group's rows; all others are joined by a shuffle.
    """
    least = max(1000, -(-rows.count() // LARGE_GROUPS))
    large = F.broadcast(groups.where(F.col(size) >= least))
    rest = rows.join(F.broadcast(groups.where(F.col(size) >= least).select(key)), key, "left_anti").join(groups.where(F.col(size) < least), key)
    return rows.join(large, key).unionByName(rest)


def row_key() -> list:
    """Columns ``_id`` and ``_hash`` that name a row of a documents table, also where ids are null or repeated."""
    return [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")]


def without(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``marked (_id, _hash)``, with the columns of ``docs``."""
    return docs.join(marked, docs["doc_id"].eqNullSafe(marked["_id"]) & (F.xxhash64(docs["text"]) == marked["_hash"]), "left_anti")


def mix(x):
    """A 64-bit hash of each element of an unsigned array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, computed when first met; emptied when it grows too large."""

    def __init__(self, most: int = 1 << 18):
        self.most = most

    def __missing__(self, word: str) -> int:
        from hashlib import blake2b

        out = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) > self.most:
            self.clear()
        if len(word) < 100:
            self[word] = out
        return out

    def of(self, words: list[str]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
