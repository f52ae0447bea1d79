"""Importance resampling of documents towards a target distribution, with a dictionary of distinct features.

Features are the runs of 1 to ``longest`` consecutive words of a text. Every task counts the features of its documents and adds
them up before anything is shuffled; each distinct feature then stands once in a dictionary, where it is hashed once. The
dictionary's counts are added up by bucket, buckets give gains, and the gains are joined back to the counts of each document:
those of frequent features from a broadcast part of the dictionary (a feature with at least 1 / ``FREQUENT`` of all occurrences,
so at most ``FREQUENT`` of them, each named by at most 64 bytes), all others by a shuffle on the feature. Documents' sums are
added up before they are shuffled in both cases, so neither a frequent feature nor a very long document meets in one task.

The draw takes the highest perturbed scores. Its ranks come from a histogram of the whole-numbered scores and an order inside
each score, never from a sort of all rows in one task.

Defined cases: null texts have no features; texts without features have weight 0; a null ``doc_id`` perturbs like the empty
string and ranks after all other ids of its score; rows repeated with id and text each have their own rank; without documents
of ``least_words`` words nobody is drawn; an empty target gives every bucket the gain of the smoothed share 1 / buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, row_key, table

BUCKETS = 10_000
FREQUENT = 100_000
#: A task holds so many distinct features before it hands their counts on.
HELD = 1 << 18
#: Words are runs of digits, ASCII letters (lower-cased) and bytes beyond ASCII; all other bytes become a space.
_WORD_BYTES = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def features(words: list[bytes], longest: int = 1) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, as often as they come."""
    return words + [b" ".join(words[i : i + n]) for n in range(2, longest + 1) for i in range(len(words) - n + 1)]


def _counted(longest: int):
    """Feature counts of whole batches, added up as far as they fit."""

    def run(batches):
        import collections

        import pyarrow as pa

        held = collections.Counter()

        def handed():
            out = pa.RecordBatch.from_pydict({"feature": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(features(words_of(text), longest))
                if len(held) > HELD:
                    yield handed()
        if held:
            yield handed()

    return run


def named(feature):
    """The feature itself, or the 64 digits of its digest where it has 64 bytes or more."""
    return F.when(F.octet_length(feature) < 64, feature).otherwise(F.sha2(feature, 256))


def counts(docs: DataFrame, longest: int = 1) -> DataFrame:
    """One row per distinct feature of ``docs (text)``: feature, n."""
    return docs.select("text").mapInArrow(_counted(longest), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row per distinct feature of either side: name, bucket, raw and target counts. Each distinct string is hashed once."""
    both = counts(docs, longest).withColumn("t", F.lit(0).cast("long")).unionByName(counts(target, longest).withColumnsRenamed({"n": "t"}).withColumn("n", F.lit(0).cast("long")))
    once = both.groupBy("feature").agg(F.sum("n").alias("raw_n"), F.sum("t").alias("target_n"))
    return once.select(named(F.col("feature")).alias("name"), (F.crc32("feature") % buckets).alias("bucket"), "raw_n", "target_n")


def bucket_gains(held: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per bucket met (at most ``buckets``): bucket, gain; smoothed by one occurrence a bucket on either side."""
    sums = held.groupBy("bucket").agg(F.sum("raw_n").alias("s"), F.sum("target_n").alias("t"))
    whole = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    # Both sides have one row per bucket at most.
    ratio = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return sums.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _per_document(longest: int):
    """Rows (_id, _hash, words, name, n): one per distinct feature of a document, and one without a name that counts the document and its words."""

    def run(batches):
        import collections
        from hashlib import sha256

        import pyarrow as pa

        schema = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("words", pa.int64()), ("name", pa.string()), ("n", pa.int64())])
        ids, hashes, words, names, times = [], [], [], [], []

        def handed():
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, hashes, words, names, times), schema, strict=True)], schema=schema)
            for x in (ids, hashes, words, names, times):
                x.clear()
            return out

        for batch in batches:
            for key, digest, text in zip(batch.column("_id").to_pylist(), batch.column("_hash").to_pylist(), batch.column("text").to_pylist(), strict=True):
                in_order = words_of(text)
                found = collections.Counter(features(in_order, longest))
                k = 1 + len(found)
                ids += [key] * k
                hashes += [digest] * k
                words += [len(in_order), *[0] * (k - 1)]
                names += [None, *(x if len(x) < 64 else sha256(x).hexdigest() for x in found)]
                times += [1, *found.values()]
                if len(ids) > 1 << 15:
                    yield handed()
        if ids:
            yield handed()

    return run


DOCUMENT = "_id long, _hash long, words long, name string, n long"


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row per distinct (id, text) of ``docs (doc_id long, text)``: _id, _hash, copies, words and features of one copy, weight (floored mean gain)."""
    bounded_batches(docs.sparkSession)
    held = cut(dictionary(docs, target, longest, buckets))
    gains = held.join(F.broadcast(bucket_gains(held, buckets)), "bucket").where("raw_n > 0").select("name", "gain", "raw_n")
    total = held.agg(F.sum("raw_n").alias("n")).first().n or 0
    least = max(100, -(-total // FREQUENT))
    frequent = gains.where(F.col("raw_n") >= least).select("name", "gain")
    each = docs.select(*row_key(), "text").mapInArrow(_per_document(longest), DOCUMENT)
    met = each.join(F.broadcast(frequent), "name", "left")
    # A document's own row has no name; its rows meet the frequent part here, so one partial sum a document and task leaves it.
    key = ["_id", "_hash"]
    sums = [F.sum(F.when(F.col("name").isNull(), F.col("n")).otherwise(0)).alias("copies"), F.sum("words").alias("words"),
            F.sum(F.when(F.col("name").isNotNull(), F.col("n")).otherwise(0)).alias("features"), F.sum(F.coalesce(F.col("n") * F.col("gain"), F.lit(0))).alias("gains")]
    near = met.groupBy(key).agg(*sums)
    rare = met.where("name IS NOT NULL AND gain IS NULL").select(*key, "name", "n").join(gains.where(F.col("raw_n") < least).select("name", "gain"), "name")
    far = rare.groupBy(key).agg(F.sum(F.col("n") * F.col("gain")).alias("gains")).withColumns({c: F.lit(0).cast("long") for c in ("copies", "words", "features")})
    both = near.unionByName(far).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("copies", "words", "features", "gains")])
    floored = F.when(F.col("features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gains - pmod(gains, features)) div features"))
    return both.select(*key, "copies", F.expr("words div copies").alias("words"), F.expr("features div copies").alias("features"), floored.alias("weight"))


def perturbation(doc_id, seed: int = 2024):
    """A whole-numbered Gumbel draw in thousandths that depends on the seed and the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """One row per row of the corpus behind ``scored`` (distinct rows with ``copies``), with ``rank`` where it is drawn.

    The scores are whole numbers of a few ten thousand values at most (they are logarithms in thousandths), so their histogram is
    small at any size; it gives the first rank of each score. Ranks inside a score are made by score, and no score holds more than
    1 in 2,000 documents unless their ids repeat, in which case they are one row here.
    """
    can = scored.where(F.col("words") >= least_words)
    bars = can.groupBy("score").agg(F.sum("copies").alias("n"))
    down = Window.orderBy(F.desc("score"))
    ahead = bars.select("score", (F.sum("n").over(down) - F.col("n")).alias("ahead"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("most"))
    inside = Window.partitionBy("score").orderBy(F.col("_id").asc_nulls_last(), "_hash").rowsBetween(Window.unboundedPreceding, -1)
    top = can.join(F.broadcast(ahead.where("ahead < most")), "score").withColumn("before", F.col("ahead") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    rest = scored.join(F.broadcast(ahead.where("ahead < most").select("score")), "score", "left_anti").unionByName(
        scored.where(F.col("words") < least_words).join(F.broadcast(ahead.where("ahead < most").select("score")), "score", "left_semi"))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    top = top.withColumn("nth", one).withColumn("rank", F.col("before") + F.col("nth")).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank")))
    return top.select(*scored.columns, "rank").unionByName(rest.withColumn("nth", one).select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per row of ``docs``: _id, _hash, copies, words, features, weight, score, rank (null where it isn't drawn)."""
    scored = cut(weights(docs, target, longest, buckets).withColumn("score", F.col("weight") + perturbation(F.col("_id"), seed)))
    return drawn(scored, percent, least_words)


def keep_drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns. Of rows repeated with id and text all stay where one is drawn."""
    some = resample(docs, target, **how).where("rank IS NOT NULL").select("_id", "_hash").distinct()
    return docs.join(some, docs["doc_id"].eqNullSafe(some["_id"]) & (F.xxhash64(docs["text"]) == some["_hash"]), "left_semi")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("_id").alias("doc_id"), F.col("features").alias("n_features"), "weight", "score", "rank")


OP11_SQL = r"""
WITH w AS (SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
bytes AS (SELECT word, [CAST('0x' || x AS INTEGER) FOR x IN regexp_extract_all(hex(encode(word)), '..')] AS b FROM (SELECT DISTINCT word FROM w)),
steps AS (SELECT word, list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(x AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN b])) AS s FROM bytes),
hashed AS (SELECT word, xor(list_reduce(s, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 10000 AS bucket FROM steps),
sums AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN hashed USING (word) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sums),
per AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM w JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN CAST((g - ((g % n) + n) % n) // n AS BIGINT) ELSE 0 END AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM documents d LEFT JOIN per USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, k AS rank FROM scored LEFT JOIN (SELECT doc_id, k FROM ranked WHERE k <= n * 10 // 100) USING (doc_id)
"""
