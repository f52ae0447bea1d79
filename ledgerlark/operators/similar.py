"""Names that look like one spelling and a typo, among all names.

Two keys whose matching blocks make up a share of at least ``SHARE`` differ by so few inserted and dropped letters that a part of one
stands whole in the other, near its own place: a join on such parts replaces the comparison of all pairs and loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reconcile import NON_LATIN, typo_hint

SHARE, LEAST_LETTERS = 0.9, 6


def longest_partner(n: Column) -> Column:
    """How long a name can be that shares enough with one of ``n`` letters: all n letters match, and that is the share of both."""
    return F.floor(n * (2 - SHARE) / SHARE + 1e-9).cast("int")


def shortest_partner(m: Column) -> Column:
    return F.greatest(F.lit(LEAST_LETTERS), F.ceil(m * SHARE / (2 - SHARE) - 1e-9).cast("int"))


def most_edits(n: Column, m: Column) -> Column:
    """How many letters can be dropped from and put into a name of n letters to give its partner of m; the number is odd where m - n is."""
    most = F.floor((1 - SHARE) * (n + m) + 1e-9).cast("int")
    return most - F.abs(most - (m - n)) % 2


def typo_candidates(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct ``keys (key)``, a before b, that can pass ``typo_hint``: as many words, a part in common at its place, few edits apart.

    Of names of n and m letters, n <= m, at most e letters apart, the shorter one is cut into e + 1 parts. Let i be the number of the
    first part that has, with all before it, no more than i edits: then the i edits are all before it, and it stands whole in the longer name. Its place
    there is shifted by i single steps to either side, and the e - i edits left must make up the rest of m - n. So the shorter name gives
    a digest for each part and length of partner, the longer one for each shift that can be. Digests that meet by chance are
    sorted out, like all others, by the edit distance.
    """
    rows = keys.where((F.length("key") >= LEAST_LETTERS) & ~F.col("key").rlike(NON_LATIN)).select("key").distinct()
    rows = rows.select("key", F.length("key").alias("len"), F.size(F.split("key", " ")).alias("words"))
    n, m, e, i, shift = map(F.col, ("n", "m", "e", "i", "shift"))

    def placed(own: DataFrame) -> DataFrame:
        own = own.withColumn("e", most_edits(n, m)).where(e >= m - n).select("*", F.explode(F.sequence(F.lit(0), e)).alias("i"))
        begin = F.expr("n * i div (e + 1)").cast("int")
        return own.select("*", begin.alias("begin"), (F.expr("n * (i + 1) div (e + 1)").cast("int") - begin).alias("size"))

    digest = lambda at: F.xxhash64("n", "m", "i", "words", F.substring("key", at + 1, F.col("size"))).alias("digest")
    shorter = placed(rows.select("key", "words", F.col("len").alias("n"), F.explode(F.sequence(F.col("len"), longest_partner(F.col("len")))).alias("m")))
    longer = placed(rows.select("key", "words", F.col("len").alias("m"), F.explode(F.sequence(shortest_partner(F.col("len")), F.col("len"))).alias("n")))
    longer = longer.select("*", F.explode(F.sequence(-i, i, F.lit(2))).alias("shift"))
    place = F.col("begin") + shift
    longer = longer.where((F.abs(m - n - shift) <= e - i) & (place >= 0) & (place + F.col("size") <= m))
    left, right = shorter.select(digest(F.col("begin")), F.col("key").alias("x")), longer.select(digest(place), F.col("key").alias("y"))
    # Tables grow many times over where names become digests, which the engine's estimate doesn't know; neither is one to broadcast.
    pairs = left.hint("merge").join(right, "digest").where((F.length("x") < F.length("y")) | (F.col("x") < F.col("y")))
    # Substitutions count once here and twice among insertions and drops, so this loses nothing either, and it runs in the engine.
    near = pairs.withColumn("most", most_edits(F.length("x"), F.length("y"))).where("levenshtein(x, y, most) >= 0")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def typo_pairs(names: DataFrame) -> DataFrame:
    """``names (id, key)``: pairs (a_id, b_id, a, b) of the least ids of two keys that pass ``typo_hint``; a hint for a reader, never a merge."""
    found = typo_candidates(names).where(typo_hint(F.col("a"), F.col("b"), SHARE))
    first = names.groupBy("key").agg(F.min("id").alias("id"))
    out = found.join(first.select(F.col("key").alias("a"), F.col("id").alias("a_id")), "a").join(first.select(F.col("key").alias("b"), F.col("id").alias("b_id")), "b")
    return out.select("a_id", "b_id", "a", "b")
