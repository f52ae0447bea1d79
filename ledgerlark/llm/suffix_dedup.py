"""Removal of byte strings that occur earlier, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Two equal strings of ``LENGTH`` bytes have the same least-hashed gram of ``GRAM`` bytes, so texts are cut into runs of windows
with one such gram, and only runs that share it can share a string. Runs whose whole bytes are equal are settled at once, by a
128-bit cryptographic digest of the bytes (each task first settles its own, so a passage copied everywhere sends one row per task). The first runs of grams that have several
different runs are dealt by gram into buckets of bounded size. A bucket is laid end to end and its suffixes are sorted to a
depth of ``LENGTH``; breadth-first backward extension on the transform then visits the intervals of ever longer strings and
so fills in the common prefixes by increasing value, stopping at ``LENGTH``: what is left open is a repeat. A gram with more
than ``HOT_BYTES`` of different runs fits no bucket; its windows are compared one by one on such digests instead, with the same result.

Defined cases: a null text counts as empty; null ids come after all others; rows repeated with one id and text are one
document, and rows of one id with other texts are separate documents ordered by a hash of the text; texts shorter than
``LENGTH`` lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, mix, table, text_or_empty

LENGTH, GRAM = 100, 32
LONGEST_RUN = 256
SLAB = 1 << 20
RUNS_HELD = 1 << 19
BUCKET_BYTES = 4 << 20
HOT_BYTES = 4 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums for the hash of any stretch, and the factors that bring a stretch to its start; they only order and block."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))[data]
    powers = np.full(len(data) + 1, MULTIPLIER, np.uint64)
    powers[0] = 1
    inverse = np.full(len(data) + 1, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * np.multiply.accumulate(powers)[:-1], out=sums[1:])
    return sums, np.multiply.accumulate(inverse)


def digests(data: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    """128-bit digests of stretches, as two numbers each."""
    out = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbours."""
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (span - width)], x[span - width :])


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one least gram: index of the text, start, length, gram hash, and the two halves of the digest of the run's bytes.

    The length is the number of windows, with bit 15 set where the run may repeat itself.
    """
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    sums, inverse = prefix_hashes(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: -GRAM])
    least = sliding_least(grams, LENGTH - GRAM + 1)
    spots = np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << 24) - 1)
    leftmost = sliding_least((grams >> np.uint64(24) << np.uint64(24)) | spots, LENGTH - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    place = np.arange(len(least)) - begins[owner]
    valid = place + LENGTH <= sizes[owner]
    at = np.flatnonzero(valid)
    value = least[at]
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (place[at[1:]] == 0)))
    count = np.diff(np.append(first, len(at)))
    parts = -(-count // LONGEST_RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(at[first], parts) + nth * LONGEST_RUN
    n = np.minimum(np.repeat(count, parts) - nth * LONGEST_RUN, LONGEST_RUN)
    end = start + n + LENGTH - 1
    whole = digests(joined, start.tolist(), end.tolist())
    who = owner[start]
    # A run over more than one place of its gram may repeat itself.
    moves = np.concatenate([[0], np.cumsum(leftmost[1:] != leftmost[:-1])])
    periodic = (moves[start + n - 1] != moves[start]) | (len(data) >= 1 << 24)
    return who, start - begins[who], n | (periodic.astype(np.int64) << 15), np.repeat(value[first], parts), whole[:, 0], whole[:, 1]


RUNS = "route long, settled boolean, whole long, rest long, doc long, tie long, spot long"


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in names.split(", ")])


def _slabs(batch: pa.RecordBatch):
    held, size = [], 0
    for doc, tie, text in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").to_pylist(), strict=True):
        raw = text.encode()
        if len(raw) >= LENGTH:
            held.append((doc, tie, raw))
            size += len(raw)
        if size > SLAB:
            yield held
            held, size = [], 0
    if held:
        yield held


def _run_batches(batches):
    """Runs to be routed by gram; of equal runs of this task all but the first are settled already."""
    held: list[tuple[np.ndarray, ...]] = []

    def out():
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.lexsort(columns[::-1])
        route, whole, rest, doc, tie, spot = (x[order] for x in columns)
        settled = np.append(False, (route[1:] == route[:-1]) & (whole[1:] == whole[:-1]) & (rest[1:] == rest[:-1]))
        same = np.append(False, (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (spot[1:] == spot[:-1])) & settled
        route = np.where(settled, mix(doc.astype(np.uint64) + spot.astype(np.uint64)).astype(np.int64), route)
        for at in range(0, len(route), 1 << 16):
            own = slice(at, at + (1 << 16))
            keep = ~same[own]
            yield _batch(RUNS, *(x[own][keep] for x in (route, settled, whole, rest, doc, tie, spot)))

    for batch in batches:
        for slab in _slabs(batch):
            who, start, n, gram, whole, rest = runs_of([raw for _, _, raw in slab])
            docs, ties = np.array([d for d, _, _ in slab], np.int64), np.array([t for _, t, _ in slab], np.int64)
            held.append((gram.astype(np.int64), whole, rest, docs[who], ties[who], (start.astype(np.int64) << 16) | n))
            if sum(len(h[0]) for h in held) > RUNS_HELD:
                yield from out()
                held = []
    if held:
        yield from out()


FOUND = "gram long, doc long, tie long, spot long, settled boolean"


def _settle_batches(batches):
    """From runs sorted by gram, bytes and place: settled runs, and the first runs of grams that have different ones.

    Only the last row of what came before is kept, so a group may be of any size.
    """
    last, pending = None, None
    names = [x.split()[0] for x in RUNS.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        route, settled, whole, rest, doc, tie, spot = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
        if last is None:
            last = (np.int64(0), True, np.int64(0), np.int64(0), None, None, None)
        before = [np.append(np.asarray([last[i]], x.dtype), x[:-1]) for i, x in enumerate((route, settled, whole, rest))]
        same_gram = (route == before[0]) & ~settled & ~before[1].astype(bool)
        same_run = same_gram & (whole == before[2]) & (rest == before[3])
        twin = np.append(last[4] is not None and (doc[0], tie[0], spot[0]) == last[4:7], (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (spot[1:] == spot[:-1])) & same_run
        done = (settled | same_run) & ~twin
        fresh = ~settled & ~same_run
        # A first run is asked for if its gram has another: the run before it, or the next fresh one, is of the same gram.
        at = np.flatnonzero(fresh)
        joined = same_gram[at]
        follows = np.append(joined[1:], False)
        ask = at[joined | follows | ((spot[at] >> 15) & 1 == 1)]
        rows = [(route[ask], doc[ask], tie[ask], spot[ask], np.zeros(len(ask), bool))]
        if len(at) and joined[0] and pending is not None:
            rows.append(tuple(np.asarray([x]) for x in pending) + (np.zeros(1, bool),))
        if len(at):
            i = at[-1]
            pending = None if joined[-1] or spot[i] >> 15 & 1 else (route[i], doc[i], tie[i], spot[i])
        rows.append((route[done], doc[done], tie[done], spot[done], np.ones(int(done.sum()), bool)))
        last = (route[-1], bool(settled[-1]), whole[-1], rest[-1], doc[-1], tie[-1], spot[-1])
        yield _batch(FOUND, *(np.concatenate(c) for c in zip(*rows, strict=True)))


def _snippet_batches(batches):
    for batch in batches:
        rows = []
        for doc, tie, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text", "asked")), strict=True):
            raw = text.encode()
            for run in asked:
                start, n = run["spot"] >> 16, run["spot"] & 0x7FFF
                rows.append((run["gram"], doc, tie, start, raw[start : start + n + LENGTH - 1]))
        columns = [*zip(*rows, strict=True)] if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["gram", "doc", "tie", "start", "bytes"])


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least, by doubling; groups of one are left alone."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    change = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.full(n + 2 * depth, -1, np.int64)
    heads = np.flatnonzero(change)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    reach, places, open_ = 8, np.arange(n), order
    while reach < depth:
        several = ~(change & np.append(change[1:], True))
        places, open_ = places[several], open_[several]
        if not len(open_):
            break
        group, then = rank[open_], rank[open_ + reach]
        inner = np.argsort((group << 32) | (then + 1))
        open_, group, then = open_[inner], group[inner], then[inner]
        change = np.append(True, (group[1:] != group[:-1]) | (then[1:] != then[:-1]))
        heads = np.flatnonzero(change)
        rank[open_] = np.repeat(places[heads], np.diff(np.append(heads, len(open_))))
        order[places] = open_
        reach *= 2
    return order


def open_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, whether it has ``depth`` bytes or more in common with the one before.

    Breadth-first backward extension: the interval of every string of length l is extended to the left by each byte in its part
    of the transform. Where the extended interval ends at a place that has no common prefix yet, that prefix is l, and the
    interval goes on to the next round.
    """
    n = len(order)
    before = data[order - 1]  # the suffix at 0 is preceded by the last byte, as on a circle
    back = np.argsort(before, kind="stable")  # places of the transform in order of the places they extend to
    to = np.empty(n, np.int64)
    to[back] = np.arange(n)
    symbol = before[back]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    parent = np.zeros(n, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(depth):
        sizes = high - low
        ids = np.repeat(np.arange(len(low)), sizes)
        places = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        parent[places] = ids
        reached = np.sort(to[places])
        up, by = parent[back[reached]], symbol[reached]
        first = np.flatnonzero(np.append(True, (reached[1:] != reached[:-1] + 1) | (up[1:] != up[:-1]) | (by[1:] != by[:-1])))
        low, high = reached[first], reached[np.append(first[1:] - 1, len(reached) - 1)] + 1
        new = ~known[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        known[high] = True
    return ~known[:n]


def repeated_windows(snippets: list[bytes]) -> np.ndarray:
    """Places, in ``snippets`` laid end to end with one blank after each, of windows whose bytes also occur at an earlier place."""
    data = np.frombuffer(b"".join(s + b"\xff" for s in snippets), np.uint8)
    order = suffix_order(data, LENGTH)
    group = np.cumsum(~open_prefixes(data, order, LENGTH))
    sizes = np.array([len(s) + 1 for s in snippets])
    left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(data))
    whole = left[order] >= LENGTH
    place, group = order[whole], group[whole]
    if not len(place):
        return place
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(place))))
    return np.sort(place[place != least])


MARKS = "doc long, tie long, begin long, end long"


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc", "tie", "start"])
    snippets = pdf["bytes"].tolist()
    at = repeated_windows(snippets)
    sizes = np.array([len(s) + 1 for s in snippets])
    begins = np.cumsum(sizes) - sizes
    row = np.searchsorted(begins, at, side="right") - 1
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]))) if len(at) else np.zeros(0, int)
    last = np.append(first[1:] - 1, len(at) - 1) if len(at) else first
    row, base = row[first], pdf["start"].to_numpy()[row[first]] - begins[row[first]]
    return pd.DataFrame({"doc": pdf["doc"].to_numpy()[row], "tie": pdf["tie"].to_numpy()[row], "begin": at[first] + base, "end": at[last] + base + LENGTH})


def _window_batches(batches):
    """Every window of hot snippets with the digest of its bytes."""
    for batch in batches:
        for doc, tie, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "start", "bytes")), strict=True):
            n = len(raw) - LENGTH + 1
            found = digests(raw, range(n), range(LENGTH, LENGTH + n))
            yield _batch("one, two, doc, tie, place", found[:, 0], found[:, 1], np.full(n, doc), np.full(n, tie), start + np.arange(n))


def _finish_batches(batches):
    for batch in batches:
        rows = []
        for doc_id, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
            raw = text.encode()
            spans: list[list[int]] = []
            for begin, end in sorted((m["begin"], m["end"]) for m in marks or ()):
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([begin, end])
            kept, at = sha256(), 0
            for begin, end in spans:
                kept.update(raw[at:begin])
                at = end
            kept.update(raw[at:])
            flat = [x for s in spans for x in s]
            rows.append((doc_id, len(raw), sum(e - b for b, e in spans), len(spans), kept.hexdigest(), flat))
        columns = [*zip(*rows, strict=True)] if rows else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, hot_bytes: int = HOT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end, begin, ...) of every row of ``docs (doc_id, text)``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"))
    twice = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice")))
    own = F.xxhash64("text")
    if twice.isEmpty():
        tie = F.when(F.col("doc_id").isNull(), own).otherwise(F.lit(0).cast("long"))
    else:
        rows = rows.join(twice, rows["doc_id"] == twice["_twice"], "left")
        tie = F.when(F.col("doc_id").isNull() | F.col("_twice").isNotNull(), own).otherwise(F.lit(0).cast("long"))
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), tie.alias("tie"), "text")
    runs = keyed.select("doc", "tie", "text").mapInArrow(_run_batches, RUNS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(parts, "route").sortWithinPartitions("route", "settled", "whole", "rest", "doc", "tie", "spot")
    found = cut(dealt.mapInArrow(_settle_batches, FOUND))
    asked = found.where(~F.col("settled")).groupBy("doc", "tie").agg(F.collect_list(F.struct("gram", "spot")).alias("asked"))
    once = keyed.select("doc", "tie", "text")
    once = once if twice.isEmpty() else once.dropDuplicates(["doc", "tie"])
    snippets = cut(once.join(asked, ["doc", "tie"]).mapInArrow(_snippet_batches, "gram long, doc long, tie long, start long, bytes binary"))
    hot = cut(snippets.groupBy("gram").agg(F.sum(F.octet_length("bytes")).alias("n")).where(F.col("n") > hot_bytes).select("gram"))
    total = snippets.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(1, total // bucket_bytes)
    cool = snippets.join(hot, "gram", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    marks = cool.groupBy("bucket").applyInPandas(_bucket, MARKS)
    windows = snippets.join(hot, "gram", "left_semi").mapInArrow(_window_batches, "one long, two long, doc long, tie long, place long")
    firsts = windows.groupBy("one", "two").agg(F.min(F.struct("doc", "tie", "place")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(firsts, ["one", "two"]).where(F.struct("doc", "tie", "place") != F.col("least")).select("doc", "tie", F.col("place").alias("begin"), (F.col("place") + LENGTH).alias("end"))
    start, n = F.shiftright("spot", 16), F.col("spot").bitwiseAND(0x7FFF)
    settled = found.where("settled").select("doc", "tie", start.alias("begin"), (start + n + LENGTH - 1).alias("end"))
    every = settled.unionByName(marks).unionByName(later).groupBy("doc", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    whole = keyed.join(cut(every), ["doc", "tie"], "left").select("doc_id", "text", "marks")
    return whole.mapInArrow(_finish_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
