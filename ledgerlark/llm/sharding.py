"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form one group. Groups are dealt by hash into buckets of bounded size; each bucket is differenced
on its own into ``shards`` partial sums, and the buckets' tuples of sums are differenced in turn, ``FAN`` at a time, until
one tuple is left. Groups of more than a ``COARSE``-th of an even share wait for that last step, where they are differenced
together with the tuples: else a bucket would have to balance a group that only all buckets together can. So no task ever holds
more than about ``GROUPS_A_BUCKET`` groups, ``FAN`` tuples or ``shards * COARSE`` large groups. A group larger than an even
share gets a shard of its own (at most ``shards`` such groups exist), as no division of the rest can lighten it.

Defined cases: a null text counts as an empty one; a null ``doc_id`` sorts first in its shard; empty input gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty

GROUPS_A_BUCKET = 4_000
FAN = 256
COARSE = 400
ROWS_A_CHUNK = 20_000
ROW_OVERHEAD = 8


def difference(tuples: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp on ``tuples`` (n, k) of partial sums: for each part of each tuple, the part of the result it lands in.

    The two tuples of largest spread are combined, one in falling and the other in rising order, until one is left.
    """
    n, k = tuples.shape
    order = np.argsort(-tuples, axis=1, kind="stable")
    vectors = list(np.take_along_axis(tuples, order, axis=1))
    heap = [(int(v[-1] - v[0]), i) for i, v in enumerate(vectors)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = vectors[a] + vectors[b][::-1]
        falling = np.argsort(-total, kind="stable")
        vectors[a] = vectors[b] = None
        total = total[falling]
        place = np.empty(k, np.int16)
        place[falling] = np.arange(k, dtype=np.int16)
        merges.append((a, b, place))
        vectors.append(total)
        heapq.heappush(heap, (int(total[-1] - total[0]), len(vectors) - 1))
    landed = {len(vectors) - 1: np.arange(k, dtype=np.int16)}
    for at in range(len(merges) - 1, -1, -1):
        a, b, place = merges[at]
        to = landed.pop(n + at)[place]
        landed[a], landed[b] = to, to[::-1]
    out = np.empty((n, k), np.int16)
    for i in range(n):
        out[i, order[i]] = landed[i]
    return out


def _leaves(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True])
        tuples = np.zeros((len(pdf), parts), np.int64)
        tuples[:, 0] = pdf["size"].to_numpy()
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "node": pdf["node"], "part": difference(tuples)[:, 0].astype("int32")})

    return run


def _nodes(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "part"])
        names, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        tuples = np.zeros((len(names), parts), np.int64)
        tuples[at, pdf["part"].to_numpy()] = pdf["size"].to_numpy()
        to = difference(tuples)[at, pdf["part"].to_numpy()]
        return pd.DataFrame({"node": pdf["node"], "part": pdf["part"], "up": pdf["parent"], "up_part": to.astype("int32")})

    return run


def assign_groups(groups: DataFrame, shards: int, bucket: int = GROUPS_A_BUCKET, fan: int = FAN) -> DataFrame:
    """``groups (key, size)`` with the shard of each: key, shard."""
    total, count = groups.agg(F.sum("size"), F.count(F.lit(1))).first()
    own, rest, parts = [], total or 0, shards
    for key, size in groups.orderBy(F.desc("size"), "key").limit(shards - 1).select("key", "size").collect():
        if parts == 1 or size * parts < rest:
            break
        own, rest, parts = [*own, key], rest - size, parts - 1
    spread = groups.where(~F.col("key").isin(own)) if own else groups
    nodes = max(1, -(-(count or 0) // bucket))
    coarse = F.col("size") * parts * COARSE > rest
    large = spread.where(coarse).select("key", "size", (-1 - F.pmod(F.xxhash64("key"), F.lit(1 << 62))).alias("node"), F.lit(0).alias("part"))
    placed = cut(
        spread.where(~coarse).withColumn("node", F.pmod(F.xxhash64("key"), F.lit(nodes)))
        .groupBy("node").applyInPandas(_leaves(parts), "key binary, size long, node long, part int")
    )
    sums = placed.groupBy("node", "part").agg(F.sum("size").alias("size"))
    while True:
        last = nodes <= fan
        nodes = 1 if last else -(-nodes // fan)
        if last:
            placed = placed.unionByName(large)
            sums = sums.unionByName(large.groupBy("node", "part").agg(F.sum("size").alias("size")))
        up = cut(
            sums.withColumn("parent", F.pmod("node", F.lit(nodes)))
            .groupBy("parent").applyInPandas(_nodes(parts), "node long, part int, up long, up_part int")
        )
        placed = placed.join(up, ["node", "part"]).select("key", "size", F.col("up").alias("node"), F.col("up_part").alias("part"))
        if last:
            break
        sums = cut(sums.join(up, ["node", "part"]).groupBy(F.col("up").alias("node"), F.col("up_part").alias("part")).agg(F.sum("size").alias("size")))
    out = placed.select("key", (F.col("part") + len(own)).alias("shard"))
    if own:
        alone = groups.sparkSession.createDataFrame([(k, i) for i, k in enumerate(own)], "key binary, shard int")
        out = out.unionByName(alone)
    return out


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every row of ``docs (doc_id, text)`` with its size, checksum, shard and place in the shard.

    Places are numbered in chunks dealt by hash of the id: counts of a chunk are summed first, so no shard is one task.
    """
    text = text_or_empty()
    rows = cut(docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    n = groups.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, -(-n // (shards * ROWS_A_CHUNK)))
    placed = cut(
        rows.join(assign_groups(groups.select("key", "size"), shards), "key")
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
        .select("doc_id", "size", "text_crc32", "shard", "chunk")
    )
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = base.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("nth", F.row_number().over(within) - 1).join(base, ["shard", "chunk"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
