"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words (case and punctuation aside). The CGK random walk reads a window from its start: at every step it
puts out the word it stands on and moves on or stays, as a random function of step and word says. So it embeds edit distance
into Hamming distance, and bit sampling finds windows close to an item: a key is the words put out at ``BITS`` sampled steps.
``WALKS`` walks with ``SETS`` keys for each reach are drawn; with them, 0.9 of the items with a fifth of their words edited are
found on average (measured in the tests), and every verbatim copy. A walk of n steps stays inside what it starts on, and moves
on half the time. So that edits in one place don't hide an item, its keys are taken from anchors all over it; a text is walked
from every word of a possible window, and what is found is shifted back by the anchor.

Before any walk, a stretch of a text must hold enough grams of ``GRAMS`` words that some item has: ``edits`` edits of an item of n
words leave n - q + 1 - q * edits of its grams of q words, so this loses nothing. What passes is a run of words that holds every
possible match whole, however long the items are. The tasks get two bitmaps (grams and keys of the items) of 16 places and more a
hash, up to 128 MB each; runs with a key are joined with the items by key, once a run and item, and the edit distance of
the best match, in words, is computed exactly over the run.

Defined cases: null, empty and wordless texts match nothing, on either side; an item of fewer than five words must match
without edits; null and repeated ids are passed through; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, cut, mix, row_key, table, without

WALKS, SETS, BITS = 4, 4, 4
REACHES = (1, 2, 4, 8, 16, 32, 64)
SHARE = 0.2
GRAMS = (1, 2, 3, 4)
#: Places of the bitmaps have so many bits at least and at most.
LEAST_BITS, MOST_BITS = 20, 30
SLAB = 1 << 19
WORD = re.compile(r"\w+")
PAD = max(REACHES)
STRIDE = 8
PAIR = 2


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edits(n):
    """Words of an item of ``n`` words that a match may lack, change or have besides."""
    return (n * SHARE).astype(int) if isinstance(n, np.ndarray) else int(n * SHARE)


def reaches(n: int) -> list[int]:
    """Lengths of the walks over an item of ``n`` words: all from 8 up that it fills, or the longest one it fills."""
    fits = [r for r in REACHES if r <= n]
    return [r for r in fits if r >= 8] or fits[-1:]


def anchors(n: int) -> dict[int, list[int]]:
    """Places in an item of ``n`` words that walks start from, with their lengths: all at its start, then one at every ``STRIDE`` words, just behind an edited opening, and at the last place for 8 steps."""
    later = {*range(STRIDE, n - 7, STRIDE), edits(n), max(0, n - 8)} - {0}
    out = {0: reaches(n)} | {a: [max(r for r in REACHES if r <= min(16, n - a))] for a in sorted(later)}
    if edits(n) == 1:
        # One edit leaves two words side by side somewhere, in an item of five words perhaps no more: walks of two steps from everywhere.
        for a in range(n - 1):
            out[a] = sorted({*out.get(a, ()), PAIR})
    return out


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the grams of ``size`` words."""
    last = len(words) - size + 1
    out = words[: max(0, last)].copy()
    for j in range(1, size):
        out = mix(out + mix(words[j : j + last] ^ np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1)))
    return out


def places(hashes: np.ndarray, bits: int, probe: int = 0) -> np.ndarray:
    """Places of hashes in a bitmap; a second probe uses other bits."""
    return ((hashes >> np.uint64(64 - bits - 12 * probe)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def marked(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def samples() -> dict[tuple[int, int, int], np.ndarray]:
    """The sampled steps of each (walk, reach, set)."""
    draw = np.random.default_rng(20)
    return {(w, r, s): np.sort(draw.choice(r, min(r, BITS), replace=False)) for w in range(WALKS) for r in REACHES for s in range(SETS if r > BITS else 1)}


def moves_of(words: np.ndarray, walk: int) -> np.ndarray:
    """For each word a bit per step of a walk: whether it moves on from there."""
    return mix(words ^ np.uint64((walk + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def walk_keys(words: np.ndarray, at: np.ndarray, used: list[int]):
    """Keys of the windows of ``words`` that start at ``at``: (reach, array of keys) for each sample of the reaches in ``used``."""
    chosen = samples()
    for walk in range(WALKS):
        moves = moves_of(words, walk)
        here = at.copy()
        keys = {(r, s): np.full(len(at), (walk << 16) + (r << 8) + s, np.uint64) for w, r, s in chosen if w == walk and r in used}
        for step in range(max(used)):
            takes = [k for k in keys if step in chosen[walk, *k]]
            if takes:
                symbol = words[here]
                for k in takes:
                    keys[k] = (keys[k] + symbol) * np.uint64(0x9E3779B97F4A7C15)
                    keys[k] ^= keys[k] >> np.uint64(29)
            here += ((moves[here] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        for (r, _), k in keys.items():
            yield r, mix(k)


def item_keys(words: np.ndarray, at: int, used: list[int]) -> list[np.ndarray]:
    """Keys of an item's walks from one place. Walks of two steps that stay on one word are left out: one word tells nothing."""
    start = np.full(1, at, np.int64)
    out = [k for _, k in walk_keys(words, start, [r for r in used if r != PAIR])] if used != [PAIR] else []
    if PAIR in used:
        moved = [bool(moves_of(words[start], walk)[0] & np.uint64(1)) for walk in range(WALKS)]
        out += [k for (_, k), m in zip(walk_keys(words, start, [PAIR]), moved, strict=True) if m or not any(moved)]
    return out


def _item_keys(batches):
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            if words:
                own = hashes.of(words)
                h = np.concatenate([own, np.zeros(PAD, np.uint64)])
                keys = np.unique(np.concatenate([k for a, used in anchors(len(words)).items() for k in item_keys(h, a, used)]))
                held = np.unique(np.concatenate([grams(own, q) for q in GRAMS]))
                rows.append((item, keys.astype(np.int64), len(words), " ".join(words), held.astype(np.int64)))
        columns = [*zip(*rows, strict=True)] if rows else [[]] * 5
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item_id", "keys", "n", "words", "grams"])


def bits_for(n: int) -> int:
    """Bits of a bitmap's places that leaves at most one place in 16 marked by ``n`` hashes, up to a map of 128 MB; fuller maps only let more through."""
    return min(MOST_BITS, max(LEAST_BITS, int(n * 16).bit_length()))


def bitmap(hashes: DataFrame, bits: int, probes: tuple[int, ...] = (0,)) -> np.ndarray:
    """A bitmap from a column of hashes: one row of 64 bits for each word of the map that is not empty."""
    place = lambda probe: F.shiftrightunsigned("hash", 64 - bits - 12 * probe).bitwiseAND((1 << bits) - 1)
    places = hashes.select(F.explode(F.array(*map(place, probes))).alias("place"))
    packed = places.select((F.col("place") / 64).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")).alias("bit"))
    rows = packed.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


FOUND = "uid long, _id long, _hash long, place long, keys array<long>, words string"


def _run_batches(maps, bits: tuple[int, int], classes: list[tuple[int, int]]):
    gram_bits, key_bits = bits
    used = sorted({r for lo, hi in classes for n in range(lo, hi + 1) for rs in anchors(n).values() for r in rs})
    # For each class of sizes: the words that a match may take up, and the grams of each size that it must hold.
    bounds = [(hi + edits(hi), [(q, few) for q in GRAMS if (few := min(n - q + 1 - q * edits(n) for n in range(lo, hi + 1))) > 0]) for lo, hi in classes]

    def possible(hashes: np.ndarray, gram_map: np.ndarray) -> np.ndarray:
        """Which words lie in a stretch with enough grams of items."""
        n, most = len(hashes), max(reach for reach, _ in bounds)
        sums = {q: np.concatenate([[0], np.cumsum(marked(gram_map, places(grams(hashes, q), gram_bits)), dtype=np.int32)]) for q in GRAMS}
        sums = {q: np.append(x, np.full(most + q, x[-1], np.int32)) for q, x in sums.items()}
        out = np.zeros(n, bool)
        for reach, needed in bounds:
            starts = np.ones(n, bool)
            for q, few in needed:
                starts &= sums[q][max(1, reach - q + 1) :][:n] - sums[q][:n] >= few
            before = np.append(0, np.cumsum(starts, dtype=np.int32))
            out |= before[1:] > before[np.maximum(np.arange(n) - reach + 1, 0)]
        return out & (hashes != 0)

    def search(hashes: np.ndarray, maps):
        """Runs of words (begin, end, keys of items in them) in texts laid end to end, each followed by ``PAD`` blanks."""
        gram_map, key_map = maps
        at = np.flatnonzero(possible(hashes, gram_map))
        if not len(at):
            return
        run = np.append(0, np.cumsum(at[1:] != at[:-1] + 1))
        runs, keys = [], []
        for _, own in walk_keys(hashes, at, used):
            hit = np.flatnonzero(marked(key_map, places(own, key_bits)) & marked(key_map, places(own, key_bits, 1)))
            runs.append(run[hit])
            keys.append(own[hit].astype(np.int64))
        runs, keys = np.concatenate(runs), np.concatenate(keys)
        heads = np.append(np.searchsorted(run, np.arange(run[-1] + 1)), len(at))
        order = np.argsort(runs, kind="stable")
        runs, keys = runs[order], keys[order]
        for i, own in zip(*(np.unique(runs), np.split(keys, np.flatnonzero(runs[1:] != runs[:-1]) + 1)), strict=False):
            yield int(at[heads[i]]), int(at[heads[i + 1] - 1]) + 1, np.unique(own)

    def run(batches):
        from pyspark import TaskContext

        hashes, uid, held = WordHashes(), TaskContext.get().partitionId() << 40, maps.value

        def slab(rows):
            nonlocal uid
            words, found = [], []
            pad = np.zeros(PAD, np.uint64)
            for _, _, w in rows:
                words += [hashes.of(w), pad]
            sizes = np.array([len(w) + PAD for _, _, w in rows])
            begins = np.cumsum(sizes) - sizes
            for begin, end, keys in search(np.concatenate(words), held):
                i = int(np.searchsorted(begins, begin, side="right")) - 1
                key, digest, own = rows[i]
                found.append((uid, key, digest, begin - int(begins[i]), keys, " ".join(own[begin - int(begins[i]) : end - int(begins[i])])))
                uid += 1
            columns = [*zip(*found, strict=True)] if found else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

        for batch in batches:
            rows, size = [], 0
            for row in zip(batch.column("_id").to_pylist(), batch.column("_hash").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(row[2])
                if words:
                    rows.append((row[0], row[1], words))
                    size += len(words)
                if size > SLAB:
                    yield slab(rows)
                    rows, size = [], 0
            if rows:
                yield slab(rows)

    return run


def best_match(item: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance, in words, between ``item`` and any stretch of ``text``, and where the first such stretch ends (Myers' bit-parallel search)."""
    n, full, high = len(item), (1 << len(item)) - 1, 1 << (len(item) - 1)
    held: dict[str, int] = {}
    for i, word in enumerate(item):
        held[word] = held.get(word, 0) | 1 << i
    up, down, score, best, end = full, 0, n, n, 0
    for at, word in enumerate(text):
        eq = held.get(word, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(zero | up)), up & zero
        score += 1 if plus & high else -1 if minus & high else 0
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
        if score < best:
            best, end = score, at + 1
    return best, end


def _verify(batches):
    """Distance of the best match of each (run, item) and where it begins, of those within the bound."""
    held: dict[str, tuple] = {}
    for batch in batches:
        rows = []
        for i, (item, stretch, place) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item_words", "words", "place")), strict=True)):
            if item not in held:
                if len(held) > 4096:
                    held.clear()
                words = item.split(" ")
                held[item] = words, set(words), set(zip(words, words[1:], strict=False)), edits(len(words))
            words, single, double, most = held[item]
            own = stretch.split(" ")
            # A match lacks at most ``most`` words of the item and twice as many pairs of words.
            if len(single.difference(own)) <= most and len(double.difference(zip(own, own[1:], strict=False))) <= 2 * most:
                best, end = best_match(words, own)
                if best <= most:
                    rows.append((i, best, place + end - best_match(words[::-1], own[:end][::-1])[1]))
        at, best, begin = (pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3))
        names = ["_id", "_hash", "item_id", "n"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), best, begin], [*names, "edits", "begin"])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (_id, _hash, item_id, n, edits, begin) of ``docs (doc_id, text)`` that hold an item of ``benchmark (item_id, text)``; ``begin`` counts words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = cut(benchmark.select("item_id", "text").mapInArrow(_item_keys, "item_id long, keys array<long>, n long, words string, grams array<long>"))
    # Sizes that differ by up to a tenth share one bound on the grams a stretch must hold.
    sizes = items.groupBy(F.floor(F.log("n") / np.log(1.1)).alias("class")).agg(F.min("n"), F.max("n")).collect()
    if not sizes:
        return spark.createDataFrame([], "_id long, _hash long, item_id long, n long, edits long, begin long")
    total = items.agg(F.sum(F.size("grams")).alias("grams"), F.sum(2 * F.size("keys")).alias("keys")).first()
    bits = bits_for(total.grams), bits_for(total.keys)
    sent = spark.sparkContext.broadcast((bitmap(items.select(F.explode("grams").alias("hash")), bits[0]), bitmap(items.select(F.explode("keys").alias("hash")), bits[1], (0, 1))))
    found = cut(docs.select(*row_key(), "text").mapInArrow(_run_batches(sent, bits, [(r[1], r[2]) for r in sizes]), FOUND))
    item_keys = items.select("item_id", F.explode("keys").alias("key")).distinct()
    pairs = found.select("uid", F.explode("keys").alias("key")).join(item_keys, "key").select("uid", "item_id").distinct()
    texts = items.select(F.col("item_id").alias("own_id"), "n", F.col("words").alias("item_words")).dropDuplicates(["own_id", "item_words"])
    candidates = pairs.join(found.drop("keys"), "uid").join(texts, F.col("item_id").eqNullSafe(F.col("own_id"))).select("_id", "_hash", "item_id", "n", "item_words", "words", "place")
    near = candidates.mapInArrow(_verify, "_id long, _hash long, item_id long, n long, edits long, begin long")
    return near.groupBy("_id", "_hash", "item_id").agg(F.min(F.struct("edits", "n", "begin")).alias("x")).select("_id", "_hash", "item_id", "x.n", "x.edits", "x.begin")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the columns of ``docs``."""
    return without(docs, cut(find_leaks(docs, benchmark).select("_id", "_hash").distinct()))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy(F.col("_id").alias("doc_id"), "item_id").agg(F.min("n").alias("item_words"), F.min("edits").alias("edits"), F.min("begin").alias("begin"))
