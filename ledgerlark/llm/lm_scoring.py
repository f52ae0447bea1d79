"""Language-model scores by context-tree weighting over bytes.

Every byte is decomposed into eight binary choices; each choice has a context tree over the preceding ``DEPTH`` bytes. The
learning rows give counts of (context, byte) grams; from them follow, depth by depth, the binary counts of every node, the
Krichevsky-Trofimov estimates, and from the leaves upwards the weighted probabilities: a node's weight is the posterior chance
that its tree ends there. A choice is predicted by mixing the estimates along its context path with those weights; a path ends
at the longest context met in learning. Text bytes and one end byte are coded; a text begins with ``DEPTH`` end bytes as
context. ASCII letters are lower-cased.

No node is dropped. A gram is kept with its nearest context byte first, so that all grams with the same ``HEAD`` nearest bytes
are one subtree: Spark deals the grams by subtree, and tasks compute the deeper nodes of each. The nodes above have at most
two bytes of context, whatever the corpus size, and travel with the tasks. That gives the log of every gram that occurs in
the texts, learned from or not. At most ``CACHED`` frequent grams travel with the scoring tasks; all others are joined in,
as are the rare words of the unigram base score beside it, whose counts are exact.

Defined cases: null and empty texts have one token, the end; null ids learn and are scored like others; with nothing to learn
from, every binary choice has probability one half, and the base score is that of a single unknown token kind.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table

DEPTH = 5
HEAD = 3
CACHED = 1 << 21
SLAB = 1 << 19
GRAMS_HELD = 3 << 20
SUBTREES_HELD = 1 << 19
FREQUENT = 1 << 16
FOLDS = 5
END = b"\xff"


def fold(column: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(FOLDS)), F.lit(0))


def slabs(texts: list[bytes]):
    """Lists of (row, part) with ``DEPTH`` bytes of context before each part and, after a text's last part, its end byte."""
    held, size = [], 0
    for i, text in enumerate(texts):
        coded = END * DEPTH + text + END
        for begin in range(0, max(1, len(coded) - DEPTH), SLAB):
            part = coded[begin : begin + SLAB + DEPTH]
            if held and size + len(part) > SLAB:
                yield held
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield held


def rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """Each code with the ``DEPTH`` before it, packed in ``width`` bits each."""
    out = codes.copy()
    for _ in range(DEPTH):
        out[1:] = codes[1:] | (out[:-1] << np.uint64(width))
    return out & np.uint64((1 << width * (DEPTH + 1)) - 1)


def own_grams(slab: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a slab, which of them are coded (not context only), and where each part's coded bytes begin."""
    data = np.frombuffer(b"".join(part for _, part in slab), np.uint8)
    lengths = np.array([len(part) for _, part in slab])
    ends = np.cumsum(lengths)
    own = np.ones(len(data), bool)
    own[((ends - lengths)[:, None] + np.arange(DEPTH)).ravel()] = False
    return data, own, np.cumsum(lengths - DEPTH) - (lengths - DEPTH)


def _lower(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode().lower() for t in batch.column("text").to_pylist()]


def nearest_first(codes: np.ndarray) -> np.ndarray:
    """Each byte with the ``DEPTH`` before it, the nearest of those in the highest place and the byte itself in the lowest."""
    out = codes.copy()
    for j in range(1, DEPTH + 1):
        out[j:] |= codes[:-j] << np.uint64(8 * (DEPTH + 1 - j))
    return out


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and their sums of each of ``counts``."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], *(np.add.reduceat(n[order], first) if len(first) else n for n in counts)


def _count_grams(batches):
    """Grams of the texts with their counts in all rows and in the learning rows."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held[0] >> 8 * (DEPTH + 1 - HEAD)), *map(pa.array, held)], ["head", "gram", "n", "learned"])

    new = []
    for batch in batches:
        texts, apart = _lower(batch), batch.column("held_out").to_pylist()
        for learning in (False, True):
            for slab in slabs([t for t, a in zip(texts, apart, strict=True) if a != learning]):
                data, own, _ = own_grams(slab)
                keys, n = np.unique(nearest_first(data.astype(np.uint64))[own], return_counts=True)
                new.append((keys.astype(np.int64), n, n * learning))
                if sum(len(x[0]) for x in new) > GRAMS_HELD // 2:
                    held, new = summed(*map(np.concatenate, zip(held, *new, strict=True))), []
                    if len(held[0]) > GRAMS_HELD:
                        yield out()
                        held = tuple(x[:0] for x in held)
    if new:
        held = summed(*map(np.concatenate, zip(held, *new, strict=True)))
    yield out()


def _subtrees(batches):
    """One row for each head, from grams that come sorted."""
    def out(grams, n, learned):
        heads = grams >> 8 * (DEPTH + 1 - HEAD)
        offsets = pa.array(np.append(np.flatnonzero(np.append(True, heads[1:] != heads[:-1])), len(heads)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (grams, n, learned)], ["grams", "n", "learned"])

    held = []
    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(c).to_numpy() for c in ("gram", "n", "learned")))
        if sum(len(x[0]) for x in held) > SUBTREES_HELD:
            rows = summed(*map(np.concatenate, zip(*held, strict=True)))
            heads = rows[0] >> 8 * (DEPTH + 1 - HEAD)
            whole = int(np.searchsorted(heads, heads[-1]))
            if whole:
                yield out(*(x[:whole] for x in rows))
            held = [tuple(x[whole:] for x in rows)]
    if held:
        yield out(*summed(*map(np.concatenate, zip(*held, strict=True))))


def _count_words(batches):
    words: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in _lower(batch):
            words.update(text.split())
        words[END] += batch.num_rows
        if len(words) > 1 << 19:
            yield out()
            words.clear()
    yield out()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma for x > 0: Stirling's series seven steps up."""
    y = x + 7
    steps = np.log(x * (x + 1)) + np.log((x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - steps


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 1.1447298858494002 - log_gamma(n0 + n1 + 1.0)


class Nodes:
    """Nodes of one depth and one binary choice: sorted keys (context, bits of the byte so far) and their values."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, split: np.ndarray | None):
        self.key, self.n0, self.n1, own = key, n0, n1, estimate(n0, n1)
        self.p = (n1 + 0.5) / (n0 + n1 + 1.0)
        self.weighted = own if split is None else np.logaddexp(own, split) - np.log(2)
        self.weight = np.ones(len(key)) if split is None else 1 / (1 + np.exp(np.minimum(split - own, 500.0)))

    def place(self, key: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))

    def descend(self, above: Nodes | None, i: int) -> None:
        """Values of a path that ends here, and what a longer path has mixed so far and has left to mix."""
        at = above.place(shorter(self.key, i)) if above else None
        mixed, left = (above.mixed[at], above.left[at]) if above else (0.0, 1.0)
        self.final = mixed + left * self.p
        self.mixed, self.left = mixed + left * self.weight * self.p, left * (1 - self.weight)


def shorter(key: np.ndarray, i: int) -> np.ndarray:
    """Keys of the nodes above those of choice ``i``: the farthest byte of the context is left out."""
    return (key >> 8 + i << i) | (key & (1 << i) - 1)


def above(below: Nodes, i: int) -> tuple[np.ndarray, ...]:
    """Keys, counts and summed weighted logs of the nodes above."""
    return summed(shorter(below.key, i), below.n0, below.n1, below.weighted)


def deep_nodes(grams: np.ndarray, learned: np.ndarray) -> list[list[Nodes]]:
    """For each choice, the nodes with ``HEAD`` to ``DEPTH`` bytes of context of whole subtrees; ``grams`` are sorted."""
    met = learned > 0
    grams, n, out = grams[met], learned[met].astype(float), []
    for i in range(8):
        ones = n * (grams >> 7 - i & 1)
        key, n0, n1 = summed(grams >> 8 - i, n - ones, ones)
        levels = [Nodes(key, n0, n1, None)]
        for _ in range(DEPTH - HEAD):
            levels.insert(0, Nodes(*above(levels[0], i)))
        out.append(levels)
    return out


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Grams and counts of a batch of subtrees, sorted by gram."""
    grams, n, learned = (batch.column(c).flatten().to_numpy() for c in ("grams", "n", "learned"))
    order = np.argsort(grams)
    return grams[order], n[order], learned[order]


def _above_heads(batches):
    """What the nodes just above the heads sum."""
    for batch in batches:
        grams, _, learned = _flat(batch)
        for i, levels in enumerate(deep_nodes(grams, learned)):
            columns = above(levels[0], i)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), i, np.int32)), *map(pa.array, columns)], ["choice", "key", "n0", "n1", "split"])


def top_nodes(sums: pa.Table) -> list[list[Nodes]]:
    """For each choice, the nodes with fewer than ``HEAD`` bytes of context."""
    choice, *columns = (sums.column(c).to_numpy() for c in ("choice", "key", "n0", "n1", "split"))
    out = []
    for i in range(8):
        levels = [Nodes(*summed(*(c[choice == i] for c in columns)))]
        for _ in range(HEAD - 1):
            levels.insert(0, Nodes(*above(levels[0], i)))
        for depth, nodes in enumerate(levels):
            nodes.descend(levels[depth - 1] if depth else None, i)
        out.append(levels)
    return out


def _gram_logs(top):
    def run(batches):
        for batch in batches:
            grams, n, learned = _flat(batch)
            logs = np.zeros(len(grams))
            for i, deep in enumerate(deep_nodes(grams, learned)):
                levels, p = [*top.value[i], *deep], np.full(len(grams), 0.5)
                for depth, nodes in enumerate(levels):
                    if depth >= HEAD:
                        nodes.descend(levels[depth - 1], i)
                    if len(nodes.key):
                        key = (grams >> 8 * (DEPTH + 1 - depth) << i) | (grams & 255) >> 8 - i
                        at = nodes.place(key)
                        p = np.where(nodes.key[at] == key, nodes.final[at], p)
                logs += np.log10(np.where(grams >> 7 - i & 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n), pa.array(logs)], ["gram", "n", "log"])

    return run


def learn_grams(docs: DataFrame) -> DataFrame:
    """Rows (gram, n, log) of every gram of ``docs (text, held_out)``, ``log10`` of its byte's chance as learned from the rows not held out."""
    spark = docs.sparkSession
    grams = docs.select("text", "held_out").mapInArrow(_count_grams, "head long, gram long, n long, learned long")
    lists = "grams array<long>, n array<long>, learned array<long>"
    bounded_batches(spark, 1 << 16)
    subtrees = cut(grams.repartition("head").sortWithinPartitions("gram").mapInArrow(_subtrees, lists))
    bounded_batches(spark)
    sums = subtrees.mapInArrow(_above_heads, "choice int, key long, n0 double, n1 double, split double")
    sums = sums.groupBy("choice", "key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "split"))).toArrow()
    top = spark.sparkContext.broadcast(top_nodes(sums))
    return cut(subtrees.mapInArrow(_gram_logs(top), "gram long, n long, log double"))


def most_frequent(logs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams, in order, and logs of at most ``CACHED`` frequent grams: those of the highest classes of counts that fit."""
    band = F.floor(F.log2("n") * 16)
    room, least = CACHED, None
    for r in logs.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["band"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    best = logs.where(band >= least).select("gram", "log").toArrow()
    order = np.argsort(best.column("gram").to_numpy())
    return best.column("gram").to_numpy()[order], best.column("log").to_numpy()[order]


def distinct_grams(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a slab and, for each coded byte, which of them it is.

    The slab's bytes are numbered densely, so that a gram and its place mostly fit into 64 bits and one sort orders both.
    """
    met = np.flatnonzero(np.bincount(data, minlength=256))
    dense = np.zeros(256, np.uint64)
    dense[met] = np.arange(len(met))
    width = max(1, int(len(met) - 1).bit_length())
    grams = rolled(dense[data], width)[own]
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    if width * (DEPTH + 1) + int(bits) <= 64:
        both = np.sort((grams << bits) | np.arange(len(grams), dtype=np.uint64))
        ordered, places = both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    else:
        places = np.argsort(grams)
        ordered = grams[places]
    first = np.append(True, ordered[1:] != ordered[:-1])
    coded, distinct = ordered[first], np.zeros(int(first.sum()), np.int64)
    for d in (*range(1, DEPTH + 1), 0):
        distinct = (distinct << 8) | met[((coded >> np.uint64(d * width)) & np.uint64((1 << width) - 1)).astype(np.int64)]
    which = np.empty(len(places), np.int64)
    which[places] = np.cumsum(first) - 1
    return distinct, which


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, n: long>>, rare_grams array<struct<gram: long, times: long>>"


def _score_batches(cached, frequent, total: int, kinds: int):
    def run(batches):
        (grams, gram_logs), known, row = cached.value, frequent.value, TaskContext.get().partitionId() << 40
        under = np.log10(total + 0.5 * (kinds + 1))
        logs = {w: (np.log10(n + 0.5) - under, n > 0) for w, n in known.items()}
        for batch in batches:
            texts = _lower(batch)
            scores, others = np.zeros(len(texts)), [(np.zeros(0, np.int64),) * 3]
            for slab in slabs(texts):
                data, own, begins = own_grams(slab)
                distinct, which = distinct_grams(data, own)
                at = np.minimum(np.searchsorted(grams, distinct), max(0, len(grams) - 1))
                hit = grams[at] == distinct if len(grams) else np.zeros(len(distinct), bool)
                values = np.where(hit, gram_logs[at], 0.0) if len(grams) else np.zeros(len(distinct))
                rows = np.array([i for i, _ in slab])
                np.add.at(scores, rows, np.add.reduceat(values[which], begins))
                if not hit.all():
                    missed = np.flatnonzero(~hit[which])
                    part = np.searchsorted(begins, missed, side="right") - 1
                    pair, times = np.unique(rows[part] * len(distinct) + which[missed], return_counts=True)
                    others.append((pair // len(distinct), distinct[pair % len(distinct)], times))
            owner, other, times = map(np.concatenate, zip(*others, strict=True))
            order = np.argsort(owner, kind="stable")
            offsets = np.searchsorted(owner[order], np.arange(len(texts) + 1)).astype(np.int32)
            rare_grams = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(other[order]), pa.array(times[order])], ["gram", "times"]))
            tokens, met, base, rare = [], [], [], []
            for text in texts:
                words = Counter(text.split())
                words[END] += 1
                tokens.append(sum(words.values()))
                hits = [(n, *logs[w]) for w, n in words.items() if w in logs]
                base.append(sum(n * x for n, x, _ in hits))
                met.append(sum(n for n, _, k in hits if k))
                rare.append([{"word": w, "n": n} for w, n in words.items() if w not in logs])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(texts))), batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(met, pa.int64()),
                pa.array(base, pa.float64()), pa.array(scores), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))), rare_grams,
            ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "rare_grams"])
            row += len(texts)

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs (doc_id long, text)``, learned from its own learning rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text", (fold() == 1).alias("held_out"))
    learning = docs.where(~F.col("held_out"))
    words = cut(learning.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    short = words.where((F.length("word") <= 64) & (F.col("word") != F.lit(END))).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = {bytes(r["word"]): r["n"] for r in short} | {END: max(0, learning.count())}
    sc = spark.sparkContext
    logs = learn_grams(docs)
    scored = cut(docs.mapInArrow(_score_batches(sc.broadcast(most_frequent(logs)), sc.broadcast(frequent), total, kinds), SCORED))
    under = float(np.log10(total + 0.5 * (kinds + 1)))
    seen = F.coalesce(words["n"], F.lit(0))
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    rare = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(seen + 0.5) - under)).alias("more"), F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    others = scored.select("row", F.explode("rare_grams").alias("x")).select("row", "x.gram", "x.times")
    others = others.join(logs, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    return scored.join(rare, "row", "left").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
