"""Near-duplicate detection by improved consistent weighted sampling.

A document is its multiset of five-word shingles, weighted by term frequency times inverse document frequency. Document
frequencies come from a count-min sketch of fixed size over all documents: it is exact enough for the shingles that matter, as
``idf = 1 + min(1, ln(N / df) / 4)`` only tells apart shingles that more than one document in 55 has. Each of ``SAMPLES``
consistent samples agrees between two documents with the probability of their weighted Jaccard similarity; ``ROWS`` samples make a
band. A band's bucket is never paired out: all its members are checked against its least member, and the links give
components. Only in buckets that still hold several components are the members outside the largest component compared with all
others, by their samples, in tiles of bounded size; pairs whose samples agree often enough are checked too, unless links found in
the tile already join them. Checks compute the weighted Jaccard similarity of the whole texts. Equal texts are one node throughout.

Missed on average: a pair of similarity 0.8 with probability 0.0008 (no band in common) plus 0.0002 (few equal samples).

Defined cases: null texts count as empty; texts without words are near only to equal texts; texts of fewer than five words have
one shingle of all their words; null ids take part, a class of null ids only is named null; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import WordHashes, bounded_batches, cut, join_groups, mix, row_key, table, text_or_empty, without

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
AGREE = SAMPLES // 2
HASH_BITS = 52
WIDTH_BITS, SKETCH_ROWS = 17, 2
SLAB, CHUNK = 1 << 19, 1 << 16
TILE, TILE_BYTES = 1024, 8 << 20
TILE_COLUMNS = ["key", "i", "j", "band", "node", "component", "codes", "left", "outside", "text"]
WORD = re.compile(r"\w+")


def shingles(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each of up to 4096 texts: index of the text, 52-bit hash, count; ordered by text and hash."""
    words = [WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in words])
    h = np.concatenate([np.zeros(0, np.uint64), *map(hashes.of, words)])
    # Short texts are filled up with a blank that no word hashes to, so that they have one shingle.
    total = h.copy()
    for _ in range(1, SHINGLE):
        total[:-1] = h[:-1] + mix(total[1:])
        total[-1:] = h[-1:]
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(h)) - np.repeat(ends - sizes, sizes)
    keep = place <= np.repeat(np.maximum(sizes - SHINGLE, 0), sizes)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    for i in short:
        at, x = ends[i] - sizes[i], np.uint64(sizes[i])
        for word in h[at : ends[i]]:
            x = mix(np.array([x]) + word)[0]
        total[at] = x
    packed = np.sort((owner[keep].astype(np.uint64) << np.uint64(HASH_BITS)) | (mix(total[keep]) >> np.uint64(64 - HASH_BITS)))
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, int)
    distinct = packed[first]
    return (distinct >> np.uint64(HASH_BITS)).astype(np.int64), distinct & np.uint64((1 << HASH_BITS) - 1), np.diff(np.append(first, len(packed)))


def cells(h: np.ndarray) -> list[np.ndarray]:
    """The sketch cell of each hash in each row of the sketch."""
    width = np.uint64((1 << WIDTH_BITS) - 1)
    return [((h >> np.uint64(i * WIDTH_BITS)) & width).astype(np.int64) for i in range(SKETCH_ROWS)]


def slabs(texts: list[str]):
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and (size + len(text) > 6 * SLAB or i - begin >= 4096):
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def _frequency_batches(batches):
    hashes, sketch = WordHashes(), np.zeros((SKETCH_ROWS, 1 << WIDTH_BITS), np.int64)
    for batch in batches:
        for _, texts in slabs(batch.column("text").to_pylist()):
            for row, at in zip(sketch, cells(shingles(texts, hashes)[1]), strict=True):
                row += np.bincount(at, minlength=len(row))
    flat = sketch.ravel()
    used = np.flatnonzero(flat)
    for at in range(0, len(used), 1 << 16):
        some = used[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["cell", "n"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch of fixed size, and the number of documents."""
    counts = docs.select(text_or_empty().alias("text")).mapInArrow(_frequency_batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(SKETCH_ROWS << WIDTH_BITS, np.int64)
    flat[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    return flat.reshape(SKETCH_ROWS, -1), docs.count()


def inverse_frequency(h: np.ndarray, sketch: np.ndarray, n: int) -> np.ndarray:
    df = np.min([row[at] for row, at in zip(sketch, cells(h), strict=True)], axis=0) if len(h) else np.zeros(0)
    return (1 + np.clip(np.log(max(n, 1) / np.maximum(df, 1)) / 4, 0, 1)).astype(np.float32)


def consistent_samples(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Codes (texts, SAMPLES) of the improved consistent weighted samples; texts without shingles get zeros."""
    best, codes = np.full((SAMPLES, texts), np.inf, np.float32), np.zeros((SAMPLES, texts), np.uint64)
    for begin in range(0, len(h), CHUNK):
        x, own, log_w = h[begin : begin + CHUNK], owner[begin : begin + CHUNK], np.log(weight[begin : begin + CHUNK])
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sizes, who = np.diff(np.append(starts, len(own))), own[starts]
        for k in range(SAMPLES):
            a = mix(x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            b = mix(a ^ np.uint64(0xD6E8FEB86659FD93))
            scale = np.float32(2.0**-21)
            u1 = ((a >> np.uint64(43)).astype(np.float32) + np.float32(0.5)) * scale
            u2 = (((a >> np.uint64(22)) & np.uint64((1 << 21) - 1)).astype(np.float32) + np.float32(0.5)) * scale
            beta = ((a & np.uint64((1 << 21) - 1)).astype(np.float32) + np.float32(0.5)) * scale
            u3 = ((b >> np.uint64(43)).astype(np.float32) + np.float32(0.5)) * scale
            u4 = ((b & np.uint64((1 << 21) - 1)).astype(np.float32) + np.float32(0.5)) * scale
            r, c = -np.log(u1 * u2), -np.log(u3 * u4)
            t = np.floor(log_w / r + beta)
            score = np.log(c) - r * (t - beta) - r
            low = np.minimum.reduceat(score, starts)
            hit = np.flatnonzero(score == np.repeat(low, sizes))
            hit = hit[np.searchsorted(hit, starts)]
            better = low < best[k, who]
            at = hit[better]
            best[k, who[better]] = low[better]
            codes[k, who[better]] = mix(x[at] ^ mix(t[at].astype(np.int64).astype(np.uint64) + np.uint64(k)))
    return codes.T


def band_keys(codes: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(codes), BANDS), np.uint64)
    for band in range(BANDS):
        keys[:, band] = band + 1
        for row in range(ROWS):
            keys[:, band] = mix(keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + codes[:, band * ROWS + row])
    return keys.astype(np.int64)


def _sample_batches(stats):
    def run(batches):
        sketch, n = stats.value
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys, codes = [], []
            for _, some in slabs(texts):
                owner, h, count = shingles(some, hashes)
                found = consistent_samples(owner, h, count.astype(np.float32) * inverse_frequency(h, sketch, n), len(some))
                blank = ~np.isin(np.arange(len(some)), owner)
                keys += [None if e else k for e, k in zip(blank, band_keys(found).tolist(), strict=True)]
                codes += [None if e else c.tobytes() for e, c in zip(blank, found.astype(np.uint32), strict=True)]
            columns = [batch.column("_id"), batch.column("_hash"), batch.column("node"), pa.array(keys, pa.list_(pa.int64())), pa.array(codes, pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_hash", "node", "keys", "codes", "n_bytes"])

    return run


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two ordered sparse vectors (hashes, weights)."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][at], b[1][bt]).sum(dtype=float)
    total = a[1].sum(dtype=float) + b[1].sum(dtype=float) - both
    return float(both / total) if total else 0.0


def _check_batches(stats):
    def run(batches):
        sketch, n = stats.value
        hashes, held = WordHashes(), {}

        def vector(node: bytes, text: str) -> tuple:
            if node not in held:
                if len(held) > 64:
                    held.clear()
                _, h, count = shingles([text], hashes)
                held[node] = h, count * inverse_frequency(h, sketch, n)
            return held[node]

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)
            near = [(a, b) for a, b, s, t in rows if weighted_jaccard(vector(a, s), vector(b, t)) >= THRESHOLD]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in near], pa.binary()), pa.array([b for _, b in near], pa.binary())], ["a", "b"])

    return run


def near(a: tuple, b: tuple) -> bool:
    """Whether two ordered sparse vectors (hashes, weights, total) are near; the totals alone often rule it out."""
    if min(a[2], b[2]) < THRESHOLD * max(a[2], b[2]):
        return False
    a, b = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum(dtype=float)
    return bool(both >= THRESHOLD * (a[2] + b[2] - both))


def _tiles(stats):
    """Links between components within each tile, from rows ordered by tile; a tile gives fewer links than it has rows."""

    def run(batches):
        sketch, n = stats.value
        hashes = WordHashes()

        def vectors(texts: dict[bytes, str]) -> dict[bytes, tuple]:
            out, names = {}, list(texts)
            for begin, some in slabs(list(texts.values())):
                owner, h, count = shingles(some, hashes)
                weight = count * inverse_frequency(h, sketch, n)
                ends = np.searchsorted(owner, np.arange(len(some) + 1))
                for i in range(len(some)):
                    w = weight[ends[i] : ends[i + 1]]
                    out[names[begin + i]] = h[ends[i] : ends[i + 1]], w, w.sum(dtype=float)
            return out

        def links(rows: list[tuple]) -> list[tuple]:
            left, right = [r for r in rows if r[7]], [r for r in rows if not r[7]]
            if not left or not right:
                return []
            band = rows[0][3]
            b = np.frombuffer(b"".join(r[6] for r in right), np.uint32).reshape(-1, SAMPLES)
            parent: dict[bytes, bytes] = {}

            def root(x: bytes) -> bytes:
                while x in parent:
                    x = parent[x]
                return x

            pairs = []
            for x in left:
                equal = b == np.frombuffer(x[6], np.uint32)
                agree = equal.sum(axis=1)
                close = np.flatnonzero(agree >= AGREE)
                # A pair belongs to the first band that both share, and once to that band's tiles.
                first = equal[close].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                for j in close[first == band]:
                    y = right[j]
                    if x[5] != y[5] and (not y[8] or x[4] < y[4]):
                        pairs.append((int(agree[j]), x, y))
            pairs.sort(key=lambda p: -p[0])
            held = vectors({r[4]: r[9] for _, x, y in pairs for r in (x, y)})
            out = []
            for _, x, y in pairs:
                p, q = root(x[5]), root(y[5])
                if p != q and near(held[x[4]], held[y[4]]):
                    parent[p] = q
                    out.append((x[4], y[4]))
            return out

        rows: list[tuple] = []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in TILE_COLUMNS), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    found += links(rows)
                    rows = []
                rows.append(row)
            yield _pairs(found)
        yield _pairs(links(rows))

    return run


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def rest_links(members: DataFrame, components: DataFrame, codes: DataFrame, own: DataFrame, stats) -> DataFrame:
    """Links (a, b) still to be found in buckets ``members (key, band, node)`` with several components.

    The members outside a bucket's largest component meet all others in tiles of bounded rows and bytes; the tiles check whole
    texts and send on links only.
    """
    labelled = members.join(components, "node", "left").join(codes.select("node", "n_bytes"), "node").select("key", "band", "node", "n_bytes", F.coalesce("component", "node").alias("component"))
    counts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("size"))
    by_key = counts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.sum("size").alias("size"), F.max(F.struct("n", "component", "size")).alias("bulk")).where("parts > 1")
    tiles = lambda n, size: F.ceil(F.greatest(n / TILE, size / TILE_BYTES)).cast("long")
    by_key = by_key.select("key", F.col("bulk.component").alias("bulk"), tiles(F.col("all"), F.col("size")).alias("tiles"), tiles(F.col("all") - F.col("bulk.n"), F.col("size") - F.col("bulk.size")).alias("left_tiles"))
    rows = cut(labelled.drop("n_bytes").join(by_key, "key").join(codes.select("node", "codes"), "node").withColumn("outside", F.col("component") != F.col("bulk")))
    spot = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    common = ["key", "band", "node", "component", "codes", "outside"]
    right = rows.select(*common, F.lit(False).alias("left"), F.pmod(spot, "tiles").alias("j"), every("left_tiles").alias("i"))
    left = rows.where("outside").select(*common, F.lit(True).alias("left"), every("tiles").alias("j"), F.pmod(spot, "left_tiles").alias("i"))
    dealt = right.unionByName(left).join(own, "node").select(*TILE_COLUMNS).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_tiles(stats), "a binary, b binary")


def near_classes(docs: DataFrame) -> DataFrame:
    """(_id, _hash, node, class_id, class_size) of every row of ``docs (doc_id, text)``.

    A class holds what equality and links of similarity ``THRESHOLD`` or more join; ``class_id`` is its least id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    stats = spark.sparkContext.broadcast(document_frequencies(docs))
    text = text_or_empty()
    rows = cut(docs.select(*row_key(), F.unhex(F.md5(text)).alias("node"), text.alias("text")).mapInArrow(_sample_batches(stats), "_id long, _hash long, node binary, keys array<long>, codes binary, n_bytes long"))
    nodes = cut(rows.groupBy("node").agg(F.min("_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("codes").alias("codes"), F.first("n_bytes").alias("n_bytes")))
    members = nodes.select(F.posexplode("keys").alias("band", "key"), "node")
    shared = cut(members.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(join_groups(members, shared, "key", "n").drop("n"))
    texts = docs.select(F.unhex(F.md5(text)).alias("node"), F.col("doc_id").alias("_id"), text.alias("text"))

    first = cut(members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())
    # Every text that shares a bucket travels once to its node.
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("least_id").alias("_least")), "node")
    own = cut(texts.join(wanted, (texts["node"] == wanted["node"]) & texts["_id"].eqNullSafe(wanted["_least"])).select(texts["node"], "text").dropDuplicates(["node"]))
    with_a = first.join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(own.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    links = cut(with_b.select("a", "b", "text_a", "text_b").mapInArrow(_check_batches(stats), "a binary, b binary"))
    rest = rest_links(members.select("key", "band", "node"), connected_components(links), nodes.select("node", "codes", "n_bytes"), own, stats)
    components = connected_components(links.unionByName(cut(rest)))
    placed = nodes.select("node", "least_id", "copies").join(components, "node", "left").select("node", "least_id", "copies", F.coalesce("component", "node").alias("component"))
    classes = placed.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = cut(placed.join(classes, "component").select("node", "class_id", "class_size"))
    return rows.select("_id", "_hash", "node").join(named, "node")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each class, that of the least id, with the columns of ``docs``."""
    gone = near_classes(docs).where(~F.col("_id").eqNullSafe(F.col("class_id"))).select("_id", "_hash").distinct()
    return without(docs, cut(gone))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "class_id", "class_size", F.col("_id").eqNullSafe(F.col("class_id")).alias("kept"))
