"""Published figures: integrity and coverage counts, monthly and weekly reports, state pages, early-warning inputs, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise
from ..functions.stats import direction
from .aggregates import jobs_where

ONCE = "superset_of = 0"


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def integrity(facts: DataFrame, events: DataFrame, reports: DataFrame, home: str) -> DataFrame:
    """One row: events with and without a linked report, rows with an event, and what is blank; each table is read once."""
    e = events.agg(F.count(F.lit(1)).alias("events"))
    r = reports.agg(F.count(F.lit(1)).alias("reports"), F.count_distinct(F.when(F.col("source_url") != "", F.col("event_id"))).alias("linked_events"))
    here = F.col("country") == home
    f = facts.agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("event_id") > 0).alias("rows_with_event"), count_if(F.col("industry") == "").alias("missing_industry"), count_if(here).alias("home_rows"), count_if(here & (F.col("state") == "")).alias("home_rows_missing_state"))
    out = f.join(e).join(r)  # one row each
    return out.withColumns({"unlinked_events": F.greatest(F.col("events") - F.col("linked_events"), F.lit(0)), "rows_remaining": F.greatest(F.col("rows") - F.col("rows_with_event"), F.lit(0)), "complete": F.col("rows") == F.col("rows_with_event")})


def link_gaps(facts: DataFrame, reports: DataFrame, limit: int = 5) -> DataFrame:
    """The first rows whose event has no linked report."""
    linked = reports.where("source_url <> ''").select("event_id")
    return facts.where("event_id > 0").join(linked, "event_id", "left_anti").select("id", "event_id", "company", "layoff_date").orderBy("id").limit(limit)


def archive_coverage(facts: DataFrame, archive: DataFrame) -> DataFrame:
    """Snapshots by status, the linked addresses without one, and the most attempts among those still cited and open."""
    urls = facts.where("source_url <> '' AND startswith(source_url, 'http')").select("source_url").distinct()
    cited = urls.select(F.md5(F.trim("source_url")).alias("url_hash")).distinct()
    by = archive.agg(*[count_if(F.col("status") == s).alias(s) for s in ("archived", "pending", "unavailable")])
    open_ = archive.where("status IN ('pending', 'unavailable')").join(cited, "url_hash", "left_semi").agg(F.count(F.lit(1)).alias("open_cited"), F.max("attempts").alias("most_attempts"))
    out = urls.agg(F.count(F.lit(1)).alias("addresses")).join(by).join(open_)  # one row each
    return out.withColumn("queued", F.greatest(F.col("addresses") - F.col("archived") - F.col("pending") - F.col("unavailable"), F.lit(0)))


def requeued(archive: DataFrame, facts: DataFrame) -> DataFrame:
    """The snapshot index with open rows marked ``uncited`` where nothing cites them, and put back in the queue where something does again."""
    cited = facts.where("source_url <> '' AND startswith(source_url, 'http')").select(F.md5(F.trim("source_url")).alias("url_hash")).distinct().withColumn("_cited", F.lit(True))
    out = archive.join(cited, "url_hash", "left")
    pending, now = F.col("status").isin("pending", "unavailable"), F.col("_cited").isNotNull()
    back = pending & F.col("uncited") & now
    return out.withColumns({"attempts": F.when(~back, F.col("attempts")), "uncited": F.when(back, False).when(pending & ~now, True).otherwise(F.col("uncited"))}).drop("_cited")


def disclosed_changes(log: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Disclosed changes of the last days by action; edits count as corrections, other actions are left out."""
    action = F.when(F.col("action") == "edited", "corrected").otherwise(F.col("action"))
    rows = log.where(F.col("day") >= F.date_sub(F.to_date(F.lit(today)), days)).select(action.alias("action"), F.greatest(F.coalesce("changes", F.lit(0)), F.lit(0)).alias("changes"))
    return rows.where(F.col("action").isin("corrected", "removed", "merged", "reclassified", "enriched")).groupBy("action").agg(F.sum("changes").alias("changes"))


# Words that tell where a correction came from.
INTERNAL = "automated|audit|dedup|backfill|reconciliation|legacy repair|duplicate cleanup|parser|self-audit|importer"
EXTERNAL = "reader|contact page|reported to us|external report|user report|tip"


def provenance(log: DataFrame) -> DataFrame:
    """Corrections by origin; what names both origins or none is unrecorded."""
    text = F.lower(F.concat_ws(" ", "action", "reason", "detail"))
    inside, outside = text.rlike(INTERNAL), text.rlike(EXTERNAL)
    origin = F.when(inside & ~outside, "internal").when(outside & ~inside, "external").otherwise("unrecorded")
    return log.groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("entries"))


def monthly_figures(facts: DataFrame, period: str) -> DataFrame:
    """(figure, rank, label, value) of one month: verified totals, those of the month before, and the first five employers, states and countries."""
    first = F.to_date(F.lit(period + "-01"))
    month = F.trunc("layoff_date", "month")
    rows = facts.where("superset_of = 0 AND NOT announced").withColumn("age", F.months_between(first, month)).where("age IN (0, 1)")
    now = F.col("age") == 0
    totals = rows.agg(jobs_where(now).alias("verified_jobs"), count_if(now).alias("entries"), jobs_where(now & F.col("ai_explicit")).alias("ai_verified_jobs"), jobs_where(~now).alias("prior_verified_jobs"))
    flat = totals.unpivot([], ["verified_jobs", "entries", "ai_verified_jobs", "prior_verified_jobs"], "figure", "value").select("figure", F.lit(0).alias("rank"), F.lit("").alias("label"), "value")
    parts = [flat]
    for column in ("company", "state", "country"):
        best = rows.where(now & (F.col(column) != "")).groupBy(F.col(column).alias("label")).agg(F.sum("job_count").alias("value")).orderBy(F.desc("value"), "label").limit(5)
        parts.append(best.select(F.lit(f"top_{column}").alias("figure"), F.row_number().over(Window.orderBy(F.desc("value"), "label")).alias("rank"), "label", "value"))
    return reduce(DataFrame.unionByName, parts)


def weekly_briefing(facts: DataFrame, as_of: str, weeks: int = 8, settle: int = 14) -> DataFrame:
    """Verified jobs by week with the median of the weeks before, whether a week may still change, and whether it is far off (over three times the median)."""
    week = F.to_date(F.date_trunc("week", F.col("layoff_date")))
    rows = facts.where("superset_of = 0 AND NOT announced AND layoff_date IS NOT NULL").groupBy(week.alias("week")).agg(F.sum("job_count").alias("jobs"), F.count(F.lit(1)).alias("entries"))
    # One row per week of the calendar, so the window holds few rows however many entries there are.
    before = Window.orderBy("week").rowsBetween(-weeks, -1)
    out = rows.withColumns({"median_before": F.percentile("jobs", 0.5).over(before), "weeks_before": F.count("jobs").over(before)})
    out = out.withColumn("median_before", F.when(F.col("weeks_before") == weeks, F.col("median_before")))
    provisional = F.datediff(F.to_date(F.lit(as_of)), F.date_add("week", 6)) < settle
    return out.select("week", "jobs", "entries", "median_before", provisional.alias("provisional"), F.coalesce(F.col("jobs") > 3 * F.col("median_before"), F.lit(False)).alias("outlier"))


def source_class(home: str) -> Column:
    """Where a row comes from, in a reader's words."""
    warn, blank = F.col("source_type") == "warn", F.col("country") == ""
    return (
        F.when(warn & ((F.col("country") == home) | (blank & (F.col("state") != ""))), "US state WARN notices")
        .when(warn & blank, "government notices with no country recorded").when(warn, "government collective-dismissal notices outside the US")
        .when(F.col("source_type") == "8K", "SEC 8-K filings").when(F.col("source_type") == "news", "named news reports").when(F.col("source_type") == "erm", "the European Restructuring Monitor")
        .otherwise("other published sources")
    )


def source_classes(facts: DataFrame, home: str) -> DataFrame:
    return facts.where("superset_of = 0 AND NOT announced").groupBy(source_class(home).alias("class")).agg(F.sum("job_count").alias("jobs"))


def region_totals(facts: DataFrame, regions: dict[str, str] | None = None) -> DataFrame:
    """Verified jobs by region of the job's place, or of the employer's home where no place is known."""
    place = normalise.region(F.col("country"), regions)
    placed = F.when(F.col("country") != "", place).otherwise(normalise.region(F.col("employer_country"), regions))
    rows = facts.where("superset_of = 0 AND NOT announced").select("job_count", placed.alias("region"), ((F.col("country") == "") & (F.col("employer_country") != "")).alias("by_home"))
    return rows.groupBy("region").agg(F.sum("job_count").alias("jobs"), jobs_where(F.col("by_home")).alias("jobs_by_home"))


def city(excerpt: Column) -> Column:
    """The city of a templated notice excerpt, or blank."""
    found = F.trim(F.regexp_replace(F.regexp_extract(F.trim(excerpt), r"^\S.* at .+ in (.+?)\.\s+[\d,]+ employees affected", 1), r"\s+", " "))
    balanced = F.length(F.regexp_replace(found, r"[^(]", "")) == F.length(F.regexp_replace(found, r"[^)]", ""))
    return F.when(balanced & (F.length(found) <= 80), found).otherwise("")


def ranked_places(notices: DataFrame, limit: int = 10) -> DataFrame:
    """``notices (company, job_count, excerpt)``: the first employers and cities by jobs, then notices, then name; names are folded by case."""
    def ranked(kind: str, label: Column) -> DataFrame:
        rows = notices.select(F.trim(label).alias("label"), F.greatest("job_count", F.lit(0)).alias("jobs"), "id").where("label <> ''")
        groups = rows.groupBy(F.lower("label").alias("key")).agg(F.min_by("label", "id").alias("label"), F.count(F.lit(1)).alias("notices"), F.sum("jobs").alias("jobs"))
        title = F.when(F.lit(kind == "city") & (F.col("label") == F.upper("label")), F.initcap("label")).otherwise(F.col("label"))
        return groups.select(F.lit(kind).alias("kind"), title.alias("label"), "notices", "jobs").orderBy(F.desc("jobs"), F.desc("notices"), "label").limit(limit)

    return ranked("employer", F.col("company")).unionByName(ranked("city", city(F.col("excerpt"))))


def notice_months(notices: DataFrame) -> DataFrame:
    return notices.where("layoff_date IS NOT NULL").groupBy(F.date_format("layoff_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("notices"), F.sum(F.greatest("job_count", F.lit(0))).alias("jobs"))


def last_changes(facts: DataFrame, column: str, today: str) -> DataFrame:
    """The latest date of each value of a column, never after today."""
    epoch = F.lit("1970-01-01").cast("date")
    day = F.least(F.to_date(F.lit(today)), F.greatest(F.coalesce(F.to_date("updated_at"), epoch), F.coalesce("announcement_date", epoch), F.coalesce("layoff_date", epoch)))
    value = F.date_format("layoff_date", "yyyy-MM") if column == "month" else F.col(column)
    return facts.where(ONCE).select(value.alias("value"), day.alias("day")).where("value <> ''").groupBy("value").agg(F.max("day").alias("last_change"))


def mean_of_means(points: DataFrame) -> DataFrame:
    """``points (series, day, value)``: the mean per month of the series' own monthly means, and how many series had one."""
    own = points.where("value IS NOT NULL").groupBy(F.date_format("day", "yyyy-MM").alias("month"), "series").agg(F.avg("value").alias("mean"))
    return own.groupBy("month").agg(F.round(F.avg("mean"), 1).alias("value"), F.count(F.lit(1)).alias("series"))


def quarter_sums(points: DataFrame, sectors: tuple[str, ...] | None = None) -> DataFrame:
    """``points (sector, day, value)`` added up by quarter, over some sectors or all."""
    rows = points.where("value IS NOT NULL") if sectors is None else points.where(F.col("value").isNotNull() & F.col("sector").isin(*sectors))
    return rows.groupBy(F.concat(F.year("day"), F.lit("-Q"), F.quarter("day")).alias("quarter")).agg(F.sum("value").alias("value"))


def notice_counts(facts: DataFrame, home: str, since: str) -> DataFrame:
    """Notices by month of filing and industry."""
    rows = facts.where(F.col("country") == home).where("source_type = 'warn' AND industry <> ''").where(F.col("announcement_date") >= F.to_date(F.lit(since)))
    return rows.groupBy(F.date_format("announcement_date", "yyyy-MM").alias("month"), "industry").agg(F.count(F.lit(1)).alias("notices"))


def early_warning(points: DataFrame) -> DataFrame:
    """``points (industry, series, official, month, value)``: each series with its recent change and direction, and the industry's status by vote of its official series."""
    nth = F.row_number().over(Window.partitionBy("industry", "series").orderBy(F.desc("month")))
    rows = points.where("value IS NOT NULL").withColumn("nth", nth)
    out = rows.groupBy("industry", "series", "official").agg(
        F.count(F.lit(1)).alias("points"), F.avg(F.when(F.col("nth") <= 3, F.col("value"))).alias("recent"), F.avg(F.when(F.col("nth").between(4, 15), F.col("value"))).alias("base"))
    change = F.when((F.col("points") >= 15) & (F.col("base") > 0), F.round(F.col("recent") / F.col("base") - 1, 6))
    out = out.withColumn("change", change).withColumn("direction", direction(F.col("change")))
    by = Window.partitionBy("industry")
    votes = {d: F.sum(F.when(F.col("official") & (F.col("direction") == d), 1).otherwise(0)).over(by) for d in ("up", "down")}
    judged = F.sum(F.when(F.col("official") & F.col("direction").isNotNull(), 1).otherwise(0)).over(by)
    status = F.when(judged < 2, None).when((votes["up"] >= 2) & (votes["up"] > votes["down"]), "heating").when((votes["down"] >= 2) & (votes["down"] > votes["up"]), "cooling").otherwise("stable")
    return out.select("industry", "series", "official", "points", "change", "direction", status.alias("status"))


def agency_months(rows: DataFrame, since: str, floor: int = 5) -> DataFrame:
    """``rows (yyyymm, agency, category, count)`` of separations by reduction: sums by agency and month from a month on, small groups left out.

    Raises where a required column is missing: a short sum would overwrite a right one.
    """
    if missing := {"yyyymm", "agency", "category", "count"} - set(rows.columns):
        raise ValueError(f"incomplete separations, no columns {sorted(missing)}")
    rows = rows.where("category = 'SH'").where(F.col("yyyymm").rlike("^[0-9]{6}$")).select("yyyymm", F.initcap(F.trim("agency")).alias("agency"), F.coalesce(F.col("count").try_cast("long"), F.lit(1)).alias("n"))
    return rows.where(F.col("yyyymm") >= since).groupBy("yyyymm", "agency").agg(F.sum("n").alias("jobs")).where(F.col("jobs").between(floor, 100000))


def ranked_rules(hits: DataFrame, floors: dict[str, int], cap: int) -> DataFrame:
    """``hits (kind, term)``: terms with enough hits for their kind, at most ``cap`` of each kind, the most frequent first."""
    counts = hits.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.where(F.col("n") >= F.coalesce(normalise.lookup({k: str(v) for k, v in floors.items()}, F.col("kind")).cast("long"), F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "term"))
    return enough.withColumn("rank", nth).where(F.col("rank") <= cap)


def top_areas(rows: DataFrame, areas: int, per_area: int, exposed: DataFrame) -> DataFrame:
    """``rows (area, occupation, jobs)``: the largest areas and, of each, the largest exposed occupations."""
    largest = rows.groupBy("area").agg(F.sum("jobs").alias("total")).orderBy(F.desc("total"), "area").limit(areas)
    nth = F.row_number().over(Window.partitionBy("area").orderBy(F.desc("jobs"), "occupation"))
    own = rows.join(largest, "area").join(exposed.select("occupation"), "occupation", "left_semi").withColumn("rank", nth)
    return own.where(F.col("rank") <= per_area).select("area", "total", "occupation", "jobs", "rank")


def quarterly_snapshot(facts: DataFrame, quarter: str) -> DataFrame:
    """(tier, entries, jobs, companies) of a calendar quarter, for the verified and announced tiers and the verified part by artificial intelligence."""
    window = normalise.quarter_window(F.lit(quarter))
    rows = facts.where(ONCE).where(F.col("layoff_date").between(window["first"], window["last"]))
    tiers = F.array_compact(F.array(F.when(~F.col("announced"), "verified"), F.when(F.col("announced"), "announced"), F.when(~F.col("announced") & (F.col("ai_causation") == "primary_cause"), "ai_primary_verified")))
    return rows.select("*", F.explode(tiers).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("entries"), F.sum("job_count").alias("jobs"), F.count_distinct("company_key").alias("companies"))


def publish_once(snapshot: DataFrame, path: str) -> DataFrame:
    """Write a snapshot where none is; one that is there stays and raises."""
    snapshot.write.mode("errorifexists").parquet(path)
    return snapshot.sparkSession.read.parquet(path)


def release(facts: DataFrame, events: DataFrame, reports: DataFrame, version: str) -> DataFrame:
    """The row counts that a release is recorded with."""
    parts = [(facts, "rows"), (events, "events"), (reports, "reports")]
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).alias("version"), F.lit(name).alias("what"), "n") for df, name in parts])


def directory_coverage(supported: DataFrame, directory: DataFrame, floor: int) -> DataFrame:
    """``supported (company_key, events)`` against ``directory (company_key, review_status)``: how many employers are above the floor, mapped, approved, held."""
    status = F.col("review_status")
    out = supported.join(directory, "company_key", "left").agg(
        F.count(F.lit(1)).alias("employers"), count_if(F.col("events") >= floor).alias("above_floor"), count_if(status.isNotNull()).alias("mapped"),
        *[count_if(status == s).alias(s) for s in ("approved", "noindex", "pending")])
    return out.withColumn("not_indexed", F.col("employers") - F.col("mapped"))


def exposure(national: DataFrame, scores: DataFrame, titles: DataFrame, growth: DataFrame) -> DataFrame:
    """Occupations with a score, their title where one is known and their growth. The side tables hold one row per occupation code, a fixed list."""
    out = national.join(scores, "occupation").join(titles, "occupation", "left").join(growth, "occupation", "left")
    return out.select("occupation", F.coalesce("title", "occupation").alias("title"), "score", "jobs", "growth")


def reference_rows(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows that have one of the comma-separated values in each named field; unknown fields raise."""
    if unknown := set(wanted) - set(rows.columns):
        raise ValueError(f"no fields {sorted(unknown)}")
    for field, values in wanted.items():
        rows = rows.where(F.col(field).cast("string").isin(*[v.strip() for v in values.split(",")]))
    return rows


def survey_comparison(facts: DataFrame, survey: DataFrame) -> DataFrame:
    """``survey (month, jobs)`` beside the ledger's own figures, of the month and of the year so far, strict and with announced entries."""
    rows = facts.where("superset_of = 0 AND layoff_date IS NOT NULL").groupBy(F.date_format("layoff_date", "yyyy-MM").alias("month")).agg(jobs_where(~F.col("announced")).alias("strict"), F.sum("job_count").alias("broad"))
    own = survey.select("month", F.col("jobs").alias("survey")).join(rows, "month", "left")
    year = Window.partitionBy(F.substring("month", 1, 4)).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumns({f"{c}_ytd": F.sum(c).over(year) for c in ("survey", "strict", "broad")})
    return out.withColumns({"strict_pct": F.when(F.col("survey") > 0, F.round(100 * F.col("strict") / F.col("survey"), 1)), "broad_ytd_pct": F.when(F.col("survey_ytd") > 0, F.round(100 * F.col("broad_ytd") / F.col("survey_ytd"), 1))})


def overlay(months: DataFrame, claims: DataFrame, place: str) -> DataFrame:
    """``months (month)`` with a place's own series ``claims (place, month, value)`` where it has one for the month, else the national one (place US)."""
    own = claims.where(F.col("place") == place).select("month", F.col("value").alias("own"))
    nation = claims.where("place = 'US'").select("month", F.col("value").alias("national"))
    return months.join(own, "month", "left").join(nation, "month", "left").select("month", F.coalesce("own", "national").alias("value"), F.when(F.col("own").isNotNull(), place).when(F.col("national").isNotNull(), "US").alias("series"))
