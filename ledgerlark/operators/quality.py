"""Measures of recall, precision, freshness and plausibility, with unknown as a state of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import dark_verdict, percent, wilson
from ..functions.text import count_in_text
from .filters import in_country


# How much history a source needs before its rhythm can be judged.
WINDOW, LEAST_SEEN, LEAST_DAYS, LEAST_SPAN = 1095, 8, 7, 180
RATE_WINDOW, LEAST_RECENT, LEAST_RECENT_SPAN, SLOWER = 365, 8, 120, 0.6


def cadence_profile(days: DataFrame, as_of: str) -> DataFrame:
    """``days (source, day)``, a row per observation: the rhythm of each source over the three years before its newest day.

    Nearest-rank 90 % and longest gap between days, yearly rates in the long run and of the last year (where that is thick
    enough), whether it slowed down, days of silence and the verdict. Too thin a history is UNKNOWN, never a pass.
    """
    per_day = days.groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source")
    rows = per_day.withColumn("newest", F.max("day").over(by)).where(F.datediff("newest", "day") <= WINDOW)
    gap = F.datediff("day", F.lag("day").over(by.orderBy("day")))
    recent = F.datediff("newest", "day") <= RATE_WINDOW
    out = rows.withColumns({"gap": gap, "recent": recent}).groupBy("source").agg(
        F.sum("n").alias("seen"), F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY gap)").cast("long").alias("gap90"), F.max("gap").alias("longest_gap"),
        F.sum(F.when(F.col("recent"), F.col("n"))).alias("recent_seen"), F.datediff(F.max(F.when(F.col("recent"), F.col("day"))), F.min(F.when(F.col("recent"), F.col("day")))).alias("recent_span"),
    )
    span = F.datediff("last_day", "first_day")
    enough = (F.col("seen") >= LEAST_SEEN) & (F.col("days") >= LEAST_DAYS) & (span >= LEAST_SPAN)
    long_run = F.when(enough, F.round((F.col("seen") - 1) / span * 365, 2))
    last_year = F.when((F.col("recent_seen") >= LEAST_RECENT) & (F.col("recent_span") >= LEAST_RECENT_SPAN), F.round((F.col("recent_seen") - 1) / F.col("recent_span") * 365, 2))
    out = out.withColumns({"long_run": long_run, "days_dark": F.greatest(F.datediff(F.to_date(F.lit(as_of)), "last_day"), F.lit(0))})
    out = out.withColumn("per_year", F.when(F.col("long_run").isNotNull(), F.coalesce(last_year, F.col("long_run"))))
    out = out.withColumns({"slowed": F.coalesce(F.col("per_year") < SLOWER * F.col("long_run"), F.lit(False)), "verdict": dark_verdict(F.col("days_dark"), F.col("per_year"), F.col("gap90"))})
    return out.select("source", "seen", "days", "first_day", "last_day", "gap90", "longest_gap", "long_run", "per_year", "slowed", "days_dark", "verdict")


def zero_streaks(runs: DataFrame) -> DataFrame:
    """How many of each source's newest runs in a row stored nothing.

    Runs are added up by source and day first: their number, and the newest that stored something. The newest such run of all days then
    splits a source: whole days behind its own count by their sums, and only its own day is read again, by source and day. So no
    task holds the runs of a source, and what is ordered are never more than the runs of one day.
    """
    at = F.struct("attempted_at", "id")
    stored = F.when(F.col("entries") > 0, at)
    dated = runs.withColumn("day", F.to_date("attempted_at"))
    days = dated.groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"), F.max(stored).alias("last"))
    sources = days.groupBy("source").agg(F.max("last").alias("last"), F.sum("n").alias("runs")).withColumn("last_day", F.to_date("last.attempted_at"))
    later = days.join(sources.select("source", "last_day"), "source").where("last_day IS NULL OR day > last_day").groupBy("source").agg(F.sum("n").alias("later"))
    own = sources.select("source", F.col("last_day").alias("day"), "last")
    same = dated.join(own, ["source", "day"]).where(F.struct("attempted_at", "id") > F.col("last")).groupBy("source").agg(F.count(F.lit(1)).alias("same"))
    streak = F.coalesce("later", F.lit(0)) + F.coalesce("same", F.lit(0))
    return sources.join(later, "source", "left").join(same, "source", "left").select("source", streak.alias("streak"), "runs")


def latest_health(runs: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "entries", "attempted_at"), F.struct("attempted_at", "id"))
    return runs.groupBy("source").agg(last.alias("x")).select("source", "x.*")


def run_tallies(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source").pivot("status", ["degraded", "ok", "running"]).agg(F.count(F.lit(1))).na.fill(0)


def systematic_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Every k-th row in order of (day, employer, id), from a start the seed gives.

    The place of a row in the whole is its place in its day plus the rows of earlier days, so no window spans more than a day.
    """
    total = rows.count()
    k = max(1, total // n)
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("rows"))
    before = days.withColumn("base", F.coalesce(F.sum("rows").over(Window.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("day", "base")
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("day").orderBy("employer", "id")) - 1)
    placed = placed.join(before.withColumnRenamed("day", "_day"), F.col("day").eqNullSafe(F.col("_day"))).withColumn("place", F.col("base") + F.col("nth"))
    return placed.where((F.col("place") >= seed % k) & ((F.col("place") - seed % k) % k == 0) & (F.col("place") < seed % k + n * k)).select("id", "day", "employer", "place")


def reference_events(notices: DataFrame) -> DataFrame:
    """Notices of one employer, state and filing day as one event."""
    return notices.groupBy("state", "company_key", "announcement_date").agg(
        F.sum("job_count").alias("jobs"), F.min("layoff_date").alias("first_effect"), F.max("layoff_date").alias("last_effect"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("components"))


def recall_by_stratum(judged: DataFrame) -> DataFrame:
    """``judged (stratum, jobs, hit)``: rate with its interval, and the rate weighted by jobs; unjudged rows are counted apart."""
    known = F.col("hit").isNotNull()
    hits, n = F.count(F.when(F.col("hit"), 1)), F.count(F.when(known, 1))
    out = judged.groupBy("stratum").agg(hits.alias("hits"), n.alias("judged"), F.count(F.when(~known, 1)).alias("undecidable"), F.sum(F.when(F.col("hit"), F.col("jobs"))).alias("hit_jobs"), F.sum(F.when(known, F.col("jobs"))).alias("jobs"))
    low, high = wilson(F.col("hits"), F.col("judged"))
    state = F.when(F.col("judged") == 0, "UNKNOWN").otherwise("MEASURED")
    return out.select("stratum", "hits", "judged", "undecidable", percent(F.col("hits"), F.col("judged")).alias("rate_pct"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), percent(F.col("hit_jobs"), F.col("jobs")).alias("weighted_pct"), state.alias("state"))


def recall_bands(references: DataFrame, matches: DataFrame) -> DataFrame:
    """CONFIRMED where a match has the count, PROPOSED where one is there at all, else ABSENT."""
    best = matches.join(references.select("ref_id", "ref_jobs"), "ref_id").groupBy("ref_id").agg(F.max((F.col("job_count") == F.col("ref_jobs")).cast("int")).alias("same"))
    band = F.when(F.col("same") == 1, "CONFIRMED").when(F.col("same") == 0, "PROPOSED").otherwise("ABSENT")
    return references.join(best, "ref_id", "left").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("events"))


def count_precision(facts: DataFrame) -> DataFrame:
    """How many entries' counts stand in their own excerpt."""
    found = F.when(F.col("excerpt") != "", count_in_text(F.col("job_count"), F.col("excerpt")))
    out = facts.groupBy("source_type").agg(F.count(F.when(found, 1)).alias("hits"), F.count(found).alias("judged"))
    low, high = wilson(F.col("hits"), F.col("judged"))
    return out.select("source_type", "hits", "judged", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def coverage_band(facts: DataFrame, denominators: DataFrame) -> DataFrame:
    """Jobs in a country, by place alone and by place or domicile, against official totals ``(country, unit, total)``.

    Unlike units are never added: more than one unit for a country gives UNKNOWN.
    """
    one = denominators.groupBy("country").agg(F.count_distinct("unit").alias("units"), F.sum("total").alias("total"))
    homes = F.array_distinct(F.filter(F.array("country", "employer_country"), lambda c: c != ""))
    rows = facts.where("superset_of = 0").select("job_count", F.col("country").alias("place"), F.explode(homes).alias("country"))
    sums = rows.groupBy("country").agg(F.sum(F.when(F.col("place") == F.col("country"), F.col("job_count"))).alias("strict_jobs"), F.sum("job_count").alias("any_jobs"))
    out = one.join(sums, "country", "left")
    share = lambda c: F.when(F.col("units") == 1, percent(F.col(c), F.col("total")))
    return out.select("country", share("strict_jobs").alias("low_pct"), share("any_jobs").alias("high_pct"), F.when(F.col("units") == 1, "MEASURED").otherwise("UNKNOWN").alias("state"))


def basis_compare(facts: DataFrame, country: str) -> DataFrame:
    total = lambda how: F.coalesce(F.sum(F.when(in_country((country,), how), F.col("job_count"))), F.lit(0))
    return facts.where("superset_of = 0").agg(total("strict").alias("strict_jobs"), total("employer").alias("employer_jobs"), total("any").alias("any_jobs"))


def ratchet(baselines: DataFrame, counts: DataFrame, tolerance: float = 0.9) -> DataFrame:
    """High-water marks ``(state, baseline)`` against present counts; marks only rise, a fall below the tolerance is drift."""
    out = baselines.join(counts, "state", "full")
    kept = F.greatest(F.coalesce("baseline", F.lit(0)), F.coalesce("n", F.lit(0)))
    verdict = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("n") < tolerance * F.coalesce("baseline", F.lit(0)), "FAIL").otherwise("PASS")
    return out.select("state", F.coalesce("n", F.lit(0)).alias("n"), kept.alias("baseline"), verdict.alias("verdict"))


def latest_decisions(entries: DataFrame) -> DataFrame:
    """Event-sourced decisions ``(case_id, seq, action, verdict)``: the last one that is not reverted."""
    last = F.max_by(F.struct("action", "verdict"), "seq")
    out = entries.groupBy("case_id").agg(last.alias("x"), F.count(F.lit(1)).alias("steps"))
    return out.select("case_id", "steps", F.when(F.col("x.action") == "revert", "OPEN").otherwise(F.col("x.verdict")).alias("verdict"))


def source_dating(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source_type").agg(F.count(F.lit(1)).alias("entries"), F.round(F.avg(F.col("layoff_date").isNotNull().cast("int")), 6).alias("dated_share"))
