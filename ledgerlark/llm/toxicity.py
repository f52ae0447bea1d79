"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; all other rows of the learning folds are unlabelled. A linear model over hashed words
and character grams minimises the non-negative risk ``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])`` with the
logistic loss, in numpy. The prior is the toxic share among labelled rows of the learning folds. Where the negative part's
estimate falls below zero, its gradient is turned round, as the method asks.

The model is fitted on at most ``POSITIVES`` confirmed and about ``UNLABELLED`` other rows (both parameters), drawn by hash of
the id; it is sent to the tasks as at most ``FEATURES`` weights, and scores every whole text.

Defined cases: null and empty texts score by the bias alone; null ids are passed through and learned from only as unlabelled
rows; several labels of one id count as toxic if one is; without a confirmed toxic row every score is about 0, and where
no feature tells toxic rows apart it is the prior, but below one half.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table, without

POSITIVES = 5_000
UNLABELLED = 10_000
FEATURES = 8_192
GRAMS = 1 << 20
SHARES = (0.005, 0.01, 0.02, 0.04)
FOLDS = 5
WORD = re.compile(r"\w+")
WORDS_HELD = 1 << 18


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(FOLDS))


def word_features(word: str) -> list[int]:
    """Hashed grams of one word: itself and its 4- and 5-character grams, the first ones marked."""
    marked = f"^{word}"
    grams = [f"={word}"] + [marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % GRAMS for g in grams]


class WordFeatures(dict):
    """Grams of words, of those in ``kept`` if given; emptied when it grows too large."""

    def __init__(self, kept: frozenset[int] | None = None):
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = word_features(word)
        out = tuple(set(found) if self.kept is None else {f for f in found if f in self.kept})
        if len(self) > WORDS_HELD:
            self.clear()
        if len(word) < 100:
            self[word] = out
        return out

    def of(self, text: str) -> np.ndarray:
        """Features of a whole text: each gram that occurs, that occurs again, and that makes up such a share of the words."""
        words = Counter(WORD.findall(text.lower()))
        per_word = [(g, n) for g, n in zip(map(self.__getitem__, words), words.values(), strict=True) if g]
        if not per_word:
            return np.zeros(0, np.int64)
        grams = np.fromiter(chain.from_iterable(g for g, _ in per_word), np.int64)
        counts = np.repeat([n for _, n in per_word], [len(g) for g, _ in per_word])
        grams, at = np.unique(grams, return_inverse=True)
        counts = np.bincount(at, counts)
        total = sum(words.values())
        levels = [grams, grams[counts >= 2] + GRAMS] + [grams[counts >= share * total] + (i + 2) * GRAMS for i, share in enumerate(SHARES)]
        return np.concatenate(levels)


def _count_batches(batches):
    """How many positive and unlabelled rows of the task have each feature."""
    known, found, held = WordFeatures(), [], 0

    def out():
        every, side = np.concatenate([f for f, _ in found]), np.repeat([s for _, s in found], [len(f) for f, _ in found])
        features, at = np.unique(every, return_inverse=True)
        counts = [pa.array(np.bincount(at, w, len(features)).astype(np.int64)) for w in (side, ~side)]
        return pa.RecordBatch.from_arrays([pa.array(features.astype(np.int64)), *counts], ["feature", "n_p", "n_u"])

    for batch in batches:
        for text, positive in zip(batch.column("text").to_pylist(), batch.column("positive").to_pylist(), strict=True):
            found.append((known.of(text or ""), bool(positive)))
            held += len(found[-1][0])
            if held > 1 << 22:
                yield out()
                found, held = [], 0
    if found:
        yield out()


def _feature_batches(chosen: np.ndarray):
    def run(batches):
        known = WordFeatures(frozenset((chosen % GRAMS).tolist()))
        for batch in batches:
            found = [np.flatnonzero(np.isin(chosen, known.of(t or ""))).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.list_(pa.int32()))], ["positive", "features"])

    return run


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature numbers of all rows, the row of each, and how many rows there are."""
    return np.concatenate([np.zeros(0, int), *rows]).astype(int), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)


def risk_and_step(weights: np.ndarray, positives: tuple, unlabelled: tuple, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the direction the method descends along: the risk's gradient, or, where the negative part is
    below zero, that part's gradient turned round."""
    k = len(weights) - 1
    (cp, rp, n_p), (cu, ru, n_u) = positives, unlabelled
    n_u = max(1, n_u)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    g_p = np.bincount(rp, weights[cp], n_p) + weights[-1]
    g_u = np.bincount(ru, weights[cu], n_u) + weights[-1]
    s_p, s_u = sigmoid(g_p), sigmoid(g_u)
    negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
    risk = prior * np.logaddexp(0, -g_p).mean() + max(0.0, negative)
    if negative >= 0:
        d_p, d_u = prior * (s_p - 1) / n_p - prior * s_p / n_p, s_u / n_u
    else:
        d_p, d_u = prior * s_p / n_p, -s_u / n_u
    return float(risk), np.append(np.bincount(cp, d_p[rp], k) + np.bincount(cu, d_u[ru], k), d_p.sum() + d_u.sum())


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], k: int, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 3e-4) -> np.ndarray:
    """Weights of ``k`` features and the bias, from the feature numbers of each row."""
    p, u = flat(positives), flat(unlabelled)
    weights = np.concatenate([np.zeros(k), [np.log(prior / (1 - prior)) - 1]])
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        _, grad = risk_and_step(weights, p, u, prior)
        grad[:-1] += decay * weights[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        weights -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return weights


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the learning folds: features, weights, bias."""
    bounded_batches(docs.sparkSession)
    marked = labels.where(F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known = marked.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n_known, n_toxic = known[0] or 0, known[1] or 0
    total = docs.count()
    grain = 1 << 30
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(grain))
    confirmed = marked.where("toxic = 1").where(drawn < int(grain * min(1.0, positives / max(1, n_toxic)))).select("doc_id", F.lit(True).alias("positive"))
    # At most about ``positives`` ids: small enough to send to every task.
    rows = docs.where(F.col("doc_id").isNull() | (fold() != 0)).select("doc_id", "text").join(F.broadcast(confirmed), "doc_id", "left")
    other = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(grain)) < int(grain * min(1.0, 1.25 * unlabelled / max(1, total)))
    rows = rows.where(F.col("positive").isNotNull() | other).select(F.coalesce("positive", F.lit(False)).alias("positive"), "text", other.alias("other"))
    # A drawn row that is also confirmed counts on both sides: the unlabelled rows stand for all rows.
    both = rows.select(F.explode(F.when(F.col("positive") & F.col("other"), F.array(F.lit(True), F.lit(False))).otherwise(F.array("positive"))).alias("positive"), "text")
    sample = cut(both)
    prior = min(0.9, max(1e-4, n_toxic / max(1, n_known)))
    sides = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = sides.get(True, 0), max(1, sides.get(False, 0))
    counts = sample.mapInArrow(_count_batches, "feature long, n_p long, n_u long").groupBy("feature").agg((F.sum("n_p") / max(1, n_p)).alias("p"), (F.sum("n_u") / n_u).alias("u"))
    # Features by the size of the difference against its own noise.
    noise = F.sqrt(F.col("p") * (1 - F.col("p")) / max(1, n_p) + F.col("u") * (1 - F.col("u")) / n_u + 1e-6)
    best = counts.withColumn("gain", (F.col("p") - F.col("u")) / noise).where("gain > 4").orderBy(F.desc("gain"), "feature").limit(FEATURES)
    chosen = np.array(sorted(r["feature"] for r in best.select("feature").collect()), np.int64)
    if not n_p or not len(chosen):
        # Nothing tells toxic rows apart: no row is called toxic on the prior alone.
        rest = min(prior, 0.49) if n_p else 1e-6
        return chosen[:0], np.zeros(0), float(np.log(rest / (1 - rest)))
    found = sample.mapInArrow(_feature_batches(chosen), "positive boolean, features array<int>").toArrow()
    side = np.asarray(found.column("positive").to_pylist(), bool)
    lists = found.column("features").combine_chunks()
    values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
    rows = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    weights = fit([r for r, s in zip(rows, side, strict=True) if s], [r for r, s in zip(rows, side, strict=True) if not s], len(chosen), prior)
    return chosen, weights[:-1], float(weights[-1])


def _scores(features: np.ndarray, weights: np.ndarray, bias: float):
    """A function from texts to scores."""
    known = WordFeatures(frozenset((features % GRAMS).tolist()))

    def margin(text: str) -> float:
        if not len(features):
            return bias
        found = known.of(text)
        at = np.minimum(np.searchsorted(features, found), len(features) - 1)
        return bias + float(weights[at[features[at] == found]].sum())

    return lambda texts: 1 / (1 + np.exp(-np.clip(np.array([margin(t or "") for t in texts], float), -700, 700)))


def _score_batches(*model):
    def run(batches):
        scores_of = _scores(*model)
        for batch in batches:
            scores = scores_of(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return run


def _toxic_batches(*model):
    def run(batches):
        scores_of = _scores(*model)
        for batch in batches:
            toxic = pa.array(scores_of(batch.column("text").to_pylist()) >= 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(toxic), batch.column("_hash").filter(toxic)], ["_id", "_hash"])

    return run


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs (doc_id long, text)``."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_score_batches(*model), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns of ``docs``."""
    features, weights, bias = learn(docs, labels)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    return without(docs, cut(rows.mapInArrow(_toxic_batches(features, weights, bias), "_id long, _hash long").distinct()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
