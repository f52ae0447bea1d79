"""Joins between entries, events, reports, snapshots and outside lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reconcile import near_days


def evidence_lists(page: DataFrame, reports: DataFrame) -> DataFrame:
    """Each row of a page with the distinct report addresses of its event in order, without its own.

    A page is small by construction, so only its events' reports are grouped.
    """
    wanted = reports.where("source_url <> ''").join(page.select("event_id").distinct(), "event_id", "left_semi")
    firsts = wanted.groupBy("event_id", "source_url").agg(F.min(F.struct("observed_at", "line", "source_name")).alias("first"))
    lists = firsts.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("first", "source_url"))).alias("found"))
    own = F.filter(F.transform("found", lambda x: x["source_url"]), lambda u: u != F.col("source_url"))
    out = page.join(lists, "event_id", "left").select("id", "event_id", F.coalesce(own, F.array().cast("array<string>")).alias("links"))
    return out.select("id", "event_id", F.array_join("links", "|").alias("links"), F.size("links").cast("long").alias("n_links"))


def with_archive(facts: DataFrame, archive: DataFrame) -> DataFrame:
    """Snapshot status by hashed address; linked rows without a snapshot are queued."""
    out = facts.where("source_url <> ''").withColumn("url_hash", F.md5(F.trim("source_url"))).join(archive, "url_hash", "left")
    return out.select("id", "url_hash", F.coalesce("status", F.lit("queued")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def unlinked_events(events: DataFrame, reports: DataFrame) -> DataFrame:
    return events.join(reports.where("source_url <> ''"), "event_id", "left_anti").select("event_id")


def archive_queue(facts: DataFrame, archive: DataFrame, limit: int = 100) -> DataFrame:
    """Distinct addresses that still need a snapshot, those never tried first."""
    urls = facts.where("source_url <> ''").groupBy("source_url").agg(F.count(F.lit(1)).alias("uses"))
    out = urls.join(archive, F.md5(F.trim("source_url")) == F.col("url_hash"), "left").where("status IS NULL OR status <> 'archived'")
    return out.orderBy(F.col("attempts").asc_nulls_first(), "source_url").limit(limit).select("source_url", "uses", "attempts")


def repaired_canonicals(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Events whose canonical row is gone, with the least member that takes its place."""
    lost = events.join(facts.select(F.col("id").alias("canonical_id")), "canonical_id", "left_anti")
    return lost.join(facts, "event_id").groupBy("event_id").agg(F.min("id").alias("canonical_id"))


def supported_directory(facts: DataFrame, events: DataFrame, floor: int = 2) -> DataFrame:
    """Employers with enough canonical events."""
    counts = facts.join(events.select("event_id", F.col("canonical_id").alias("id")), ["event_id", "id"], "left_semi").groupBy("company_key").agg(F.count_distinct("event_id").alias("events"))
    return counts.where(F.col("events") >= floor)


def lifecycle_pairs(facts: DataFrame) -> DataFrame:
    """Announced entries and what may be their execution: same employer, count and country, up to a year later."""
    a = facts.where("announced AND layoff_date IS NOT NULL").select("company_key", "job_count", "country", *[F.col(c).alias(f"a_{c}") for c in ("id", "state", "event_id", "source_url", "layoff_date")])
    b = facts.where("NOT announced AND layoff_date IS NOT NULL").select("id", "company_key", "job_count", "country", "state", "event_id", "source_url", "layoff_date")
    near = ((F.col("a_state") == "") | (F.col("state") == "") | (F.col("a_state") == F.col("state"))) & (F.col("a_event_id") != F.col("event_id"))
    apart = (F.col("a_source_url") != F.col("source_url")) | (F.col("source_url") == "")
    pairs = near_days(a, "a_layoff_date", b, "layoff_date", ["company_key", "job_count", "country"], 365, before=False).where(near & apart)
    return pairs.select(F.col("a_id").alias("announced_id"), F.col("id").alias("executed_id"), F.datediff("layoff_date", "a_layoff_date").alias("days"))


def unseen(incoming: DataFrame, facts: DataFrame, reports: DataFrame) -> DataFrame:
    """Addresses that neither entries nor reports have."""
    known = facts.select("source_url").union(reports.select("source_url")).where("source_url <> ''").distinct()
    return incoming.where("source_url <> ''").join(known, "source_url", "left_anti")


def earlier_same_count(facts: DataFrame, days: int = 180) -> DataFrame:
    """Entries whose employer reported the same count more than so many days before, with the latest such entry.

    An as-of lookup: a running window over earlier entries of (employer, count), ordered by day.
    """
    rows = facts.where("company_key <> '' AND layoff_date IS NOT NULL AND source_type <> 'warn'").withColumn("n", F.datediff("layoff_date", F.lit("1970-01-01").cast("date")))
    window = Window.partitionBy("company_key", "job_count").orderBy("n").rangeBetween(Window.unboundedPreceding, -days - 1)
    return rows.withColumn("earlier", F.max(F.struct("n", "id")).over(window)).where("earlier IS NOT NULL").select("id", F.col("earlier.id").alias("earlier_id"), (F.col("n") - F.col("earlier.n")).alias("days"))


def fuzzy_matches(incoming: DataFrame, facts: DataFrame, days: int = 30, ratio: int = 3) -> DataFrame:
    """Entries that an incoming one may repeat: same employer, so many days around, and not three times as large."""
    a = incoming.where("layoff_date IS NOT NULL").select("company_key", F.col("id").alias("new_id"), F.col("layoff_date").alias("d"), F.col("job_count").alias("j"))
    rows = facts.where("layoff_date IS NOT NULL").select("company_key", "id", "layoff_date", "job_count")
    hits = near_days(a, "d", rows, "layoff_date", ["company_key"], days).where((F.col("j") < ratio * F.col("job_count")) & (F.col("new_id") != F.col("id")))
    return hits.groupBy("new_id").agg(F.min_by("id", F.struct(F.abs(F.datediff("layoff_date", "d")), "id")).alias("matched_id"), F.count(F.lit(1)).alias("matches"))


def unique_name_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``(id, name, country)`` whose name and country are unique on both sides."""

    def unique(rows: DataFrame, alias: str) -> DataFrame:
        groups = rows.where("name <> ''").groupBy("name", "country").agg(F.count_distinct("id").alias("n"), F.min("id").alias(alias))
        return groups.where("n = 1").drop("n")

    return unique(left, "left_id").join(unique(right, "right_id"), ["name", "country"])


def beginnings(key: Column) -> Column:
    """All beginnings of a key in whole words."""
    words = F.split(key, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))


def token_prefix_matches(aliases: DataFrame, facts: DataFrame, before: int = 90, after: int = 270) -> DataFrame:
    """Aliases ``(ref_id, alias_key, ref_day)`` whose words begin an employer's key, within a window of days.

    A key meets aliases by equality with each of its own beginnings, so a frequent first word brings no pairs.
    """
    f = facts.where("layoff_date IS NOT NULL AND company_key <> ''").select("id", "layoff_date", "job_count", F.explode(beginnings(F.col("company_key"))).alias("alias_key"))
    days = F.datediff("layoff_date", "ref_day")
    return aliases.where("alias_key <> ''").join(f, "alias_key").where(days.between(-before, after)).select("ref_id", "id", days.alias("days"), "job_count")


def seen_presence(names: DataFrame, facts: DataFrame) -> DataFrame:
    """Listed names with the number of entries under the same key."""
    counts = facts.groupBy("company_key").agg(F.count(F.lit(1)).alias("entries"))
    return names.join(counts, "company_key", "left").select("company_key", F.coalesce("entries", F.lit(0)).alias("entries"), F.col("entries").isNotNull().alias("present"))


def aligned_presence(names: DataFrame, facts: DataFrame) -> DataFrame:
    """Listed names ``(name_id, name_key)`` with the number of employers whose key begins with all their words, or all of whose words they begin with.

    Keys are counted per beginning first, so a frequent first word brings a number and no pairs.
    """
    keys = facts.where("company_key <> ''").select("company_key").distinct()
    listed = names.where("name_key <> ''")
    begun = keys.select(F.explode(beginnings(F.col("company_key"))).alias("name_key")).groupBy("name_key").agg(F.count(F.lit(1)).alias("n"))
    longer = listed.join(begun, "name_key").select("name_id", "n")
    own = listed.select("name_id", "name_key", F.explode(beginnings(F.col("name_key"))).alias("company_key")).where("company_key <> name_key")
    shorter = own.join(keys, "company_key").select("name_id", F.lit(1).cast("long").alias("n"))
    counts = longer.union(shorter).groupBy("name_id").agg(F.sum("n").alias("employers"))
    return names.join(counts, "name_id", "left").select("name_id", F.coalesce("employers", F.lit(0)).alias("employers"), F.col("employers").isNotNull().alias("present"))
