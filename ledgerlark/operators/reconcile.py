"""Joins and audits across names, dates and snapshots, and the rows of the public interface."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import let
from ..functions.employers import company_key, same_employer
from .components import connected_components
from .filters import tier


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def near_days(left: DataFrame, left_day: str, right: DataFrame, right_day: str, keys: list[str], days: int, before: bool = True) -> DataFrame:
    """Pairs with equal keys and at most ``days`` between their days (after only, unless ``before``).

    The days are put into buckets as wide as the band, and each left row meets its own and the neighbouring buckets: rows of a
    frequent key are spread over time, and a bucket never meets rows that are far away.
    """
    width = days + 1
    reach = (-1, 0, 1) if before else (0, 1)
    a = left.withColumn("_at", F.explode(F.transform(F.array(*map(F.lit, reach)), lambda i: F.floor(day_number(F.col(left_day)) / width) + i)))
    b = right.withColumn("_at", F.floor(day_number(F.col(right_day)) / width))
    gap = F.datediff(right_day, left_day)
    return a.join(b, [*keys, "_at"]).where(gap.between(-days if before else 0, days)).drop("_at")


#: Places that fit any country.
WILD = ("", "Multiple countries")


def _nearest(points: DataFrame, asked: DataFrame, ratio: float, k: int) -> DataFrame:
    """For every (list, n) of ``asked`` the ``k`` ids of ``points (list, n, id)`` whose counts have the best ratio to n, of those within ``ratio``.

    Only the ``k`` least ids of a count can be among them, so equal counts are reduced before anything is shuffled by list. Counts
    are put into logarithmic buckets as wide as the ratio and copied over the borders, so a bucket holds some counts of three
    buckets, never more than whole numbers lie in them, however many rows there are. Inside a bucket counts are numbered in order and each
    question looks up the ``k`` before and behind it by number: no pair is made that isn't a neighbour.
    """
    size = F.floor(F.log("n") / -F.log(F.lit(ratio)))
    nth = F.row_number().over(Window.partitionBy("list", "n").orderBy("id"))
    counts = points.withColumn("_nth", nth).where(F.col("_nth") <= k).groupBy("list", "n").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    copied = counts.withColumn("bucket", F.explode(F.array(size - 1, size, size + 1)))
    numbered = copied.withColumn("at", F.row_number().over(Window.partitionBy("list", "bucket").orderBy("n")))
    asked = asked.distinct().withColumn("bucket", size)
    both = numbered.select("list", "bucket", "n", F.lit(1).alias("held")).unionByName(asked.select("list", "bucket", "n", F.lit(0).alias("held")))
    before = F.sum("held").over(Window.partitionBy("list", "bucket").orderBy("n").rangeBetween(Window.unboundedPreceding, 0))
    places = both.withColumn("upto", before).where("held = 0").select("list", "bucket", "n", F.explode(F.sequence(F.col("upto") - k, F.col("upto") + k)).alias("at"))
    share = F.least("n", "count") / F.greatest("n", "count")
    found = places.join(numbered.select("list", "bucket", "at", F.col("n").alias("count"), "ids"), ["list", "bucket", "at"]).withColumn("share", share).where(F.col("share") >= ratio)
    each = found.groupBy("list", "n").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("share")).alias("apart"), i.alias("id"))))).alias("all"))
    return each.select("list", "n", F.slice(F.array_sort("all"), 1, k).alias("near"))


def dateless_neighbours(facts: DataFrame, ratio: float = 0.98, limit: int = 5, least: int = 1000) -> DataFrame:
    """For undated rows, up to so many rows that they may repeat: nearly equal counts in a country that fits, the same country first, then the closest count.

    A row asks two lists of counts: its own country's, and either all rows (where its own place fits any country) or the rows whose place
    does. Both give their best; twice the limit is enough to put them together.
    """
    rows = facts.where(F.col("job_count") >= least).select("id", F.col("job_count").alias("n"), "country", F.col("layoff_date").isNull().alias("undated"))
    wild = F.col("country").isin(*WILD)
    one = lambda kind, value=F.lit(""): F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    own, second = one("country", F.col("country")), F.when(wild, one("all")).otherwise(one("wild"))
    lists = F.array_compact(F.array(own, one("all"), F.when(wild, one("wild"))))
    points = rows.select(F.explode(lists).alias("list"), "n", "id")
    undated = rows.where("undated").select("id", "n", own.alias("own"), second.alias("second"))
    asked = undated.select(F.explode(F.array("own", "second")).alias("list"), "n")
    near = _nearest(points, asked, ratio, 2 * limit + 2)
    answers = lambda name: near.select(F.col("list").alias(name), "n", F.col("near").alias(f"near_{name}"))
    found = undated.join(answers("own"), ["own", "n"], "left").join(answers("second"), ["second", "n"], "left")
    empty = F.array().cast("array<struct<apart: double, id: bigint>>")
    here, there = F.coalesce("near_own", empty), F.coalesce("near_second", empty)
    ranked = lambda x, far: F.transform(x, lambda e: F.struct(F.lit(far).alias("far"), e["apart"].alias("apart"), e["id"].alias("id")))
    others = F.filter(there, lambda e: ~F.exists(here, lambda h: h["id"] == e["id"]))
    best = F.slice(F.array_sort(F.filter(F.concat(ranked(here, 0), ranked(others, 1)), lambda e: e["id"] != F.col("id"))), 1, limit)
    return found.select(F.col("id").alias("undated_id"), F.posexplode(best).alias("at", "x")).select("undated_id", F.col("x.id").alias("id"), (F.col("at") + 1).alias("rank"))


# Scripts without Latin letters (Greek, Cyrillic, Hebrew, Arabic, Thai, kana, Chinese characters, Hangul).
NON_LATIN = r"[\x{0370}-\x{03FF}\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"


def script_mismatch(a: Column, b: Column) -> Column:
    """Whether one of two names has letters of a script that the other can't be compared with as words."""
    return a.rlike(NON_LATIN) != b.rlike(NON_LATIN)


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def typo_hint(a: Column, b: Column, share: float = 0.9) -> Column:
    """Whether two identity keys of six letters or more and as many words look like one spelling and a typo; a hint for a reader, never a merge.

    Matching blocks have no built-in function, so pairs that pass the cheap tests are compared in Arrow batches.
    """
    words = lambda c: F.size(F.split(c, " "))
    gates = (a != b) & (F.least(F.length(a), F.length(b)) >= 6) & (words(a) == words(b)) & ~a.rlike(NON_LATIN) & ~b.rlike(NON_LATIN)
    ratio = F.pandas_udf(_similarity, DoubleType())(F.when(gates, a), F.when(gates, b))
    return F.coalesce(gates & (ratio >= share), F.lit(False))


def cross_alias_groups(facts: DataFrame, days: int = 2) -> DataFrame:
    """(id, component) of rows that are one event under several names: one count, nearly one day, one employer, or names in two scripts on the same day."""
    rows = facts.where("layoff_date IS NOT NULL AND lower(source_type) NOT IN ('warn', 'federal_rif') AND job_count > 0").select("id", "event_id", "company", "company_key", "job_count", "layoff_date")
    a = rows.select("job_count", *[F.col(c).alias(f"a_{c}") for c in rows.columns if c != "job_count"])
    pairs = near_days(a, "a_layoff_date", rows, "layoff_date", ["job_count"], days).where("a_id < id AND a_event_id <> event_id")
    same = same_employer(F.col("a_company_key"), F.col("company_key"), F.col("a_company"), F.col("company"))
    other = script_mismatch(F.col("a_company"), F.col("company")) & (F.col("a_layoff_date") == F.col("layoff_date"))
    return connected_components(pairs.where(same | other | (F.col("a_company_key") == F.col("company_key"))).select(F.col("a_id").alias("a"), F.col("id").alias("b"))).withColumnRenamed("node", "id")


def notice_hash(company: Column, day: Column, jobs: Column, state: Column) -> Column:
    """The digest of an official notice; the city is no part of it, so corrected cities overwrite."""
    return F.md5(F.concat(F.lit("warn"), F.lower(F.trim(company)), F.coalesce(day.cast("string"), F.lit("")), jobs.cast("string"), F.lower(state)))


def agency_hash(agency: Column, yyyymm: Column) -> Column:
    """The digest of an agency's month; the count is no part of it, so revised counts overwrite."""
    return F.md5(F.concat(F.lit("fedrif"), F.lower(F.trim(agency)), yyyymm))


# Legal forms and words for a group that a bucket key leaves out.
LEGAL_DOTTED = r"(?i)[\s,]+(?:s\.p\.?a\.?|a\.s\.?|a/s|n\.v\.?|b\.v\.?|d\.d\.?|s\.a\.r\.l\.?|sp\.?\s*z\s*o\.\s*o\.?)\s*$"
LEGAL_TAIL = r"(?:\s(?:gmbh|oyj|sarl|asa|sas|nv|bv|ab|as|se|oy|kg))+$"
GROUP_LEAD, GROUP_TRAIL = r"^(?:grupo|groupe|gruppo|grupa|gruppen|gruppe|groep)\s", r"\s(?:grupo|groupe|gruppo|grupa|gruppen|gruppe|groep)$"


def bucket_key(name: Column) -> Column:
    """A key wider than the identity key, for finding candidates only: without a parenthesis, legal form or "group", but never empty."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    shorter = lambda to: lambda out: let(to(out), lambda x: F.when(F.trim(x) != "", x).otherwise(out))
    head = F.btrim(F.regexp_replace(F.regexp_replace(raw, r"\s*\([^)]*\)", " "), r"\s+", " "), F.lit(" ,-"))

    def named(h: Column) -> Column:
        letters = F.length(F.regexp_replace(h, "[^A-Za-z0-9]", ""))
        return F.when((letters >= 5) | ((letters >= 3) & h.rlike("[a-z]")), h).otherwise(raw)

    out = let(let(head, named), shorter(lambda c: F.regexp_replace(c, LEGAL_DOTTED, "")))
    out = F.trim(F.regexp_replace(F.lower(out), "[^a-z0-9]+", " "))
    for pattern in (LEGAL_TAIL, GROUP_LEAD, GROUP_TRAIL):
        out = let(out, shorter(lambda c, p=pattern: F.trim(F.regexp_replace(c, p, " "))))
    return let(company_key(out), lambda key: F.when(key != "", key).otherwise(company_key(raw)))


# How strong a source is as the row that stays.
SOURCE_RANK = {"8K": 3, "warn": 3, "press_release": 2, "erm": 2, "news": 1}


def canonical_of(groups: DataFrame) -> DataFrame:
    """``groups (cluster, id, announced, layoff_date, source_type)``: the row that stays: verified before announced, then the earliest, then the strongest source."""
    rank = F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in SOURCE_RANK.items()], F.lit(0))
    order = F.struct(F.col("announced").cast("int"), F.coalesce(F.col("layoff_date").cast("string"), F.lit("9999")), -rank, "id")
    return groups.groupBy("cluster").agg(F.min_by("id", order).alias("canonical_id"), F.count(F.lit(1)).alias("n"))


def interface_rows(facts: DataFrame, archive: DataFrame) -> DataFrame:
    """Entries as the interface shows them: place, tier, unpacked tags, and the address of a snapshot."""
    place = F.concat_ws(", ", F.when(F.col("state") != "", F.col("state")), F.when(F.col("country") != "", F.col("country")))
    links = archive.where("status = 'archived'").select("url_hash")
    out = facts.withColumn("url_hash", F.md5(F.trim("source_url"))).join(links.withColumn("_kept", F.lit(True)), "url_hash", "left")
    link = F.when((F.col("source_url") != "") & F.col("_kept").isNotNull(), F.concat(F.lit("/archive/"), "url_hash")).otherwise("")
    return out.select("id", "company", F.when(place == "", "Not recorded").otherwise(place).alias("location"), tier().alias("tier"), F.array_join("reason_tags", "|").alias("reasons"), F.array_join(F.array_remove("role_categories", "unknown"), "|").alias("roles"), link.alias("archived_at"))


def membership_flags(facts: DataFrame, home: str) -> DataFrame:
    """Whether a row belongs to a country's headline by the job's place, by the employer's home, or to their union by one of the two alone."""
    once = F.col("superset_of") == 0
    here, domestic = F.col("country") == home, F.col("employer_country") == home
    own = F.when(F.col("employer_country") != "", domestic).otherwise(here)
    return facts.select("id", (once & here).alias("by_place"), (once & own).alias("by_home"), (once & (here != domestic)).alias("union_only"))


def follow_matches(facts: DataFrame, follows: DataFrame, first: str, last: str, limit: int = 10) -> DataFrame:
    """``follows (follow_id, kind, value)`` of employers and states: rows written or dated within a window, the largest first, up to a limit each."""
    a, b = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    day = F.coalesce("announcement_date", "layoff_date")
    rows = facts.where("superset_of = 0").where(F.to_date("updated_at").between(a, b) | day.between(a, b))
    keyed = rows.select("id", "job_count", F.explode(F.create_map(F.lit("company"), "company_key", F.lit("state"), "state")).alias("kind", "value")).where("value <> ''")
    nth = F.row_number().over(Window.partitionBy("follow_id").orderBy(F.desc("job_count"), F.desc("id")))
    return keyed.join(follows, ["kind", "value"]).withColumn("rank", nth).where(F.col("rank") <= limit).select("follow_id", "id", "rank")


def moved_reports(reports: DataFrame, moves: DataFrame) -> DataFrame:
    """Reports with those of ``moves (source_url, from_event, to_event)`` put to their new event; a report that is there already stays one."""
    out = reports.join(moves.dropDuplicates(["source_url", "from_event"]), (reports["source_url"] == moves["source_url"]) & (reports["event_id"] == moves["from_event"]), "left")
    return out.select(F.coalesce("to_event", "event_id").alias("event_id"), *[reports[c] for c in reports.columns if c != "event_id"]).distinct()


def backfilled(facts: DataFrame, proposals: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """``facts`` with blanks of a column filled from ``proposals (id, value, quote)``: allowed values only, with a quote of twelve characters or more that stands in the row's excerpt; edited rows stay."""
    ok = proposals.where(F.col("value").isin(*allowed)).groupBy("id").agg(F.min_by(F.struct("value", "quote"), "value").alias("_p"))
    out = facts.join(ok, "id", "left")
    quote = F.lower(F.trim(F.col("_p.quote")))
    fits = (F.length(quote) >= 12) & F.contains(F.lower(F.col("excerpt")), quote) & (F.col(column) == "") & ~F.col("edited")
    return out.withColumn(column, F.when(fits, F.col("_p.value")).otherwise(F.col(column))).select(*facts.columns)


def migrated_events(facts: DataFrame, after: int, n: int) -> DataFrame:
    """The next batch of rows without an event by id, with the event they get; resumable by the last id."""
    return facts.where((F.coalesce("event_id", F.lit(0)) == 0) & (F.col("id") > after)).orderBy("id").limit(n).select("id", (F.col("id") + 1000000000).alias("event_id"))


def replaced_partial_month(months: DataFrame, as_of: str) -> DataFrame:
    """``months (month, jobs, jobs_to_date)``: the running month by what is done so far, with the rest as a remainder still to come; later months are all remainder."""
    now = as_of[:7]
    done = F.when(F.col("month") < now, F.col("jobs")).when(F.col("month") == now, F.col("jobs_to_date")).otherwise(F.lit(0))
    return months.select("month", done.alias("jobs"), (F.col("jobs") - done).alias("still_to_come"), (F.col("month") == now).alias("partial"))


def reranked(tops: DataFrame) -> DataFrame:
    """``tops (label, jobs, verified_jobs)`` by verified jobs, those without any dropped, missing figures taken from all jobs."""
    value = F.coalesce("verified_jobs", "jobs")
    return tops.select("label", value.alias("jobs")).where("jobs > 0").orderBy(F.desc("jobs"), "label")


def needs_log_scale(points: DataFrame, share: float = 25) -> DataFrame:
    """Whether the highest points of the series in a chart lie more than so many times apart."""
    tops = points.groupBy("label").agg(F.max("jobs").alias("top")).where("top > 0")
    return tops.agg(F.coalesce(F.max("top") / F.min("top") > share, F.lit(False)).alias("log_scale"), F.count(F.lit(1)).alias("series"))


def daily_slice(work: DataFrame, day: str, size: int) -> DataFrame:
    """``work (key)``: so many of the distinct keys, in order of their digests, from a place that moves on every day and wraps around.

    The place of a key is its place among those with the same first digits plus the keys of earlier digits, so nothing is sorted in one task.
    """
    digest = F.md5(F.col("key").cast("string"))
    rows = work.select("key").distinct().withColumns({"_d": digest, "_b": F.substring(digest, 1, 3)})
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows
    base = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_d")) - 1 + F.col("_base")
    first = day_number(F.to_date(F.lit(day))) * size
    return rows.join(base, "_b").withColumn("_at", at).where(F.pmod(F.col("_at") - first, F.col("_all")) < size).select("key")


def containment_groups(pairs: DataFrame) -> DataFrame:
    """Slices whose baselines must move together: the components of ``pairs (part, whole)``."""
    names = pairs.select(F.col("part").alias("a"), F.col("whole").alias("b"))
    return connected_components(names).select(F.col("node").alias("slice"), F.col("component").alias("group"))


def gold_recall(gold: DataFrame, matches: DataFrame, floor: float) -> DataFrame:
    """``gold (case_id, adjudicated)`` against ``matches (case_id)``: found, recall, verdict by a floor, and cases that were found when judged and are lost now."""
    found = matches.select("case_id").distinct().withColumn("_found", F.lit(True))
    rows = gold.join(found, "case_id", "left").withColumn("hit", F.col("_found").isNotNull())
    out = rows.agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("hit"), 1)).alias("found"), F.count(F.when(F.col("adjudicated") & ~F.col("hit"), 1)).alias("lost"))
    recall = F.when(F.col("cases") > 0, F.round(F.col("found") / F.col("cases"), 6))
    return out.withColumn("recall", recall).withColumn("verdict", F.when(F.col("recall").isNull(), "UNKNOWN").when((F.col("recall") < floor) | (F.col("lost") > 0), "FAIL").otherwise("PASS"))


def pooled_recall(strata: DataFrame) -> DataFrame:
    """``strata (stratum, hits, judged, population)``: recall pooled by judged cases and weighted by the strata's populations; strata without judged cases take no part and are counted."""
    used = F.col("judged") > 0
    out = strata.agg(
        F.sum(F.when(used, F.col("hits"))).alias("hits"), F.sum(F.when(used, F.col("judged"))).alias("judged"), F.count(F.when(~used, 1)).alias("unjudged"),
        (F.sum(F.when(used, F.col("hits") / F.col("judged") * F.col("population"))) / F.sum(F.when(used, F.col("population")))).alias("w"),
    )
    return out.select("hits", "judged", "unjudged", F.when(F.col("judged") > 0, F.round(F.col("hits") / F.col("judged"), 6)).alias("recall"), F.round("w", 6).alias("weighted_recall"))


def headline_movement(baseline: DataFrame, now: DataFrame, removed: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``baseline`` and ``now`` ``(slice, jobs)``, ``removed (slice, jobs)`` by disclosed corrections: a fall beyond the tolerance that they don't explain fails."""
    out = baseline.select("slice", F.col("jobs").alias("was")).join(now.select("slice", F.col("jobs").alias("now")), "slice", "left").join(removed.select("slice", F.col("jobs").alias("disclosed")), "slice", "left")
    fall = F.col("was") - F.col("now") - F.coalesce("disclosed", F.lit(0))
    return out.select("slice", "was", "now", F.coalesce("disclosed", F.lit(0)).alias("disclosed"), F.when(F.col("now").isNull(), "UNKNOWN").when(fall > tolerance * F.col("was"), "FAIL").otherwise("PASS").alias("verdict"))


def containment(slices: DataFrame, pairs: DataFrame, residual: int = 25000) -> DataFrame:
    """``slices (slice, run, was, now)`` and ``pairs (part, whole)``: a part must not exceed its whole, nor move by more than the residual against it; figures of two runs are UNKNOWN."""
    p = slices.select(F.col("slice").alias("part"), F.col("run").alias("part_run"), F.col("was").alias("part_was"), F.col("now").alias("part_now"))
    w = slices.select(F.col("slice").alias("whole"), F.col("run").alias("whole_run"), F.col("was").alias("whole_was"), F.col("now").alias("whole_now"))
    moved = (F.col("part_now") - F.col("part_was")) - (F.col("whole_now") - F.col("whole_was"))
    verdict = F.when(F.col("part_run").isNull() | F.col("whole_run").isNull() | (F.col("part_run") != F.col("whole_run")), "UNKNOWN").when((F.col("part_now") > F.col("whole_now")) | (moved > residual), "FAIL").otherwise("PASS")
    return pairs.join(p, "part", "left").join(w, "whole", "left").select("part", "whole", moved.alias("residual"), verdict.alias("verdict"))


def country_coverage(facts: DataFrame, register: DataFrame) -> DataFrame:
    """Countries with entries against ``register (country, regime)``: covered, uncovered or unclassified, with what they hold."""
    own = facts.where("superset_of = 0 AND country <> ''").groupBy("country").agg(F.count(F.lit(1)).alias("entries"), F.sum("job_count").alias("jobs"))
    kind = F.when(F.col("regime").isNull(), "UNCLASSIFIED").when(F.col("regime") == "none", "NO_REGIME").when(F.col("entries").isNull(), "NOT_COVERED").otherwise("COVERED")
    return own.join(register, "country", "full").select("country", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("jobs", F.lit(0)).alias("jobs"), kind.alias("class"))


def city_recall(cases: DataFrame, facts: DataFrame, days: int = 45) -> DataFrame:
    """``cases (case_id, city, company, jobs, day)``: found by employer and day, with the count or without, per city. Cases whose employer's name holds the city are set aside: the name would give them away."""
    leak = F.contains(F.lower("company"), F.lower("city"))
    keyed = cases.withColumns({"company_key": company_key(F.col("company")), "leak": leak})
    pairs = near_days(keyed.where(~F.col("leak")), "day", facts.where("layoff_date IS NOT NULL").select("company_key", "layoff_date", "job_count"), "layoff_date", ["company_key"], days)
    best = pairs.groupBy("case_id").agg(F.max((F.col("jobs") == F.col("job_count")).cast("int")).alias("exact"))
    out = keyed.join(best, "case_id", "left").groupBy("city")
    return out.agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("leak"), 1)).alias("set_aside"), F.count(F.when(F.col("exact") == 1, 1)).alias("exact"), F.count("exact").alias("found"))


def audience_order(rows: DataFrame, home: str) -> DataFrame:
    """Rows of the readers' own country first, then by jobs, notices and name."""
    return rows.orderBy(F.when(F.col("country") == home, 0).otherwise(1), F.desc("jobs"), F.desc("notices"), "label")


def collected(sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The entries of several collectors in one list, each with its collector's name; columns that one lacks are null."""
    parts = [df.withColumn("collector", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("collector", *columns)


def allowed_tags(tags: Column, vocabulary: tuple[str, ...]) -> Column:
    """The tags of a closed vocabulary, without the marker for unknown."""
    return F.array_except(F.array_intersect(tags, F.array(*map(F.lit, vocabulary))), F.array(F.lit("unknown")))


def concentration_verdict(facts: DataFrame, bound: float, headline: int | None = None) -> DataFrame:
    """Whether one row carries more than its bound of a headline: UNKNOWN without rows, FAIL also where the headline is not what these rows add up to."""
    out = facts.where("superset_of = 0").agg(F.max_by("id", F.struct("job_count", -F.col("id"))).alias("id"), F.max("job_count").alias("largest"), F.sum("job_count").alias("jobs"))
    share = F.when(F.col("jobs") > 0, F.round(F.col("largest") / F.col("jobs"), 6))
    apart = F.lit(False) if headline is None else F.col("jobs") != headline
    return out.withColumn("share", share).withColumn("verdict", F.when(F.col("share").isNull(), "UNKNOWN").when(apart | (F.col("share") >= bound), "FAIL").otherwise("PASS"))


# Words that name artificial intelligence.
NAMES_AI = r"(?i)\bAI\b|\bartificial intelligence\b|\bautomat\w+|\bmachine learning\b|\brobot\w*|\bgenerative\b|\balgorithm\w*|\bchatbots?\b"


def quote_precision(facts: DataFrame, quote: str) -> DataFrame:
    """Of the rows that count as caused by artificial intelligence: how many have a quote, and one that names it."""
    q = F.trim(F.coalesce(quote, F.lit("")))
    out = facts.where("ai_explicit").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(q != "", 1)).alias("quoted"), F.count(F.when(q.rlike(NAMES_AI), 1)).alias("named"))
    return out.withColumn("rate_pct", F.when(F.col("rows") > 0, F.round(100 * F.col("named") / F.col("rows"), 1)))


def panel_verdicts(votes: DataFrame, large: int) -> DataFrame:
    """``votes (case_id, jobs, approve, cited)``: any explicit no rejects; only a unanimous panel that cites its evidence applies a change, and a large one still waits for review."""
    out = votes.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("votes"), F.max("jobs").alias("jobs"), F.count(F.when(~F.col("approve"), 1)).alias("noes"), F.count(F.when(F.col("approve") & F.coalesce("cited", F.lit(False)), 1)).alias("clean"))
    clean = (F.col("votes") > 0) & (F.col("clean") == F.col("votes"))
    return out.select("case_id", "votes", F.when(F.col("noes") > 0, "REJECT").when(clean & (F.col("jobs") < large), "AUTO_APPLY").otherwise("HOLD_FOR_REVIEW").alias("verdict"))


def recall_by_size(cases: DataFrame, matches: DataFrame, days: int = 45) -> DataFrame:
    """``cases (case_id, company_key, jobs, day)`` against ``matches (company_key, job_count, day)``: candidates and exact counts by size band (L from 500, M from 100, S)."""
    left = cases.select("case_id", "company_key", "jobs", F.col("day").alias("case_day"))
    pairs = near_days(left, "case_day", matches, "day", ["company_key"], days)
    best = pairs.groupBy("case_id").agg(F.max((F.col("jobs") == F.col("job_count")).cast("int")).alias("exact"))
    band = F.when(F.col("jobs").isNull(), "UNKNOWN").when(F.col("jobs") >= 500, "L").when(F.col("jobs") >= 100, "M").otherwise("S")
    out = cases.join(best, "case_id", "left").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("cases"), F.count("exact").alias("candidates"), F.count(F.when(F.col("exact") == 1, 1)).alias("exact"))
    return out.withColumn("candidate_pct", F.round(100 * F.col("candidates") / F.col("cases"), 1))
