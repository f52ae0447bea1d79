"""Totals, rankings, facets and reports over the ledger.

Job totals count every event once (``superset_of = 0``), except where a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percent
from .filters import FilterSpec, basis, compile_dimensions, compile_filters, tier
from .reconcile import near_days

ONCE = "superset_of = 0"


def jobs_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("job_count"))), F.lit(0)).cast("long")


def measures() -> list[Column]:
    """Jobs in all, by artificial intelligence, verified, and both."""
    verified = tier() == "verified"
    yes = F.lit(True)
    return [jobs_where(yes).alias("jobs"), jobs_where(F.col("ai_explicit")).alias("ai_jobs"), jobs_where(verified).alias("verified_jobs"), jobs_where(verified & F.col("ai_explicit")).alias("verified_ai_jobs")]


def totals(facts: DataFrame) -> DataFrame:
    """One pass: counts, jobs by tier and cause, distinct employers and places, date range, and the rows left out."""
    once, ai, said = F.col("superset_of") == 0, F.col("ai_explicit"), F.col("announced")
    distinct = lambda c, when=once: F.count_distinct(F.when(when & (F.col(c) != ""), F.col(c)))
    count = lambda c: F.count(F.when(c, 1))
    return facts.agg(
        count(once).alias("entries"), jobs_where(once).alias("jobs"), count(once & ai).alias("ai_entries"), jobs_where(once & ai).alias("ai_jobs"),
        jobs_where(once & (F.col("ai_causation") == "primary_cause")).alias("ai_primary_jobs"), jobs_where(once & (ai | (F.col("ai_causation") == "ai_linked"))).alias("ai_broad_jobs"),
        count(once & said).alias("announced_entries"), jobs_where(once & said).alias("announced_jobs"), jobs_where(once & ~said).alias("confirmed_jobs"),
        jobs_where(once & (tier() == "verified")).alias("verified_jobs"), jobs_where(once & (tier() == "verified") & ai).alias("verified_ai_jobs"),
        distinct("company_key").alias("companies"), distinct("country").alias("countries"), distinct("industry").alias("industries"), distinct("state").alias("states"),
        distinct("company_key", once & ai).alias("ai_companies"), F.min(F.when(once & (F.year("layoff_date") >= 1990), F.col("layoff_date"))).alias("first_date"),
        F.max(F.when(once, F.col("layoff_date"))).alias("last_date"), count(~once).alias("excluded_entries"), jobs_where(~once).alias("excluded_jobs"),
    )


def concentration(facts: DataFrame) -> DataFrame:
    """The largest entry and its share of all jobs; the least id wins a tie."""
    largest = F.max_by(F.struct("id", "company", "job_count"), F.struct("job_count", -F.col("id")))
    out = facts.where(ONCE).agg(largest.alias("x"), F.sum("job_count").alias("all_jobs"))
    return out.select("x.id", "x.company", "x.job_count", "all_jobs", percent(F.col("x.job_count"), F.col("all_jobs"), 4).alias("share_pct"))


def top(facts: DataFrame, spec: FilterSpec, column: str, limit: int = 60) -> DataFrame:
    """Jobs per value of a dimension, its own filter left aside; blanks are no values."""
    rows = facts.where(compile_filters(spec.without("sources" if column == "source_type" else column))).where(ONCE)
    value = tier() if column == "tier" else F.col(column)
    out = rows.groupBy(value.alias("label")).agg(*measures()).where("label <> ''")
    return out.orderBy(F.desc("jobs"), "label").limit(limit)


#: Blocks of the interface's aggregate, and the filter that each leaves aside so that it keeps showing all of its own values.
BLOCKS = {"total": None, "country": "country", "employer_country": "employer_country", "industry": "industry", "state": "state", "source_type": "sources", "tier": "tier", "month": None, "reason": "reasons", "role": None}


def endpoint(facts: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """(block, label, entries, measures) of all blocks of the interface's aggregate in one scan and one shuffle, under any filters.

    Each filter that some block leaves aside has a bit; a row's mask has the bits of those that it fails. Rows that fail any other
    filter, or two of these, are in no block and go at once. A row is dealt to its label in each block whose own bit is all that its
    mask may have, so a row that fails one filter goes to one block. Months lie on the filters' own date. The partial sums per task are
    as many as there are labels, whatever the number of rows.
    """
    spec = spec or FilterSpec()
    tests = compile_dimensions(spec)
    own = [name for name in dict.fromkeys(BLOCKS.values()) if name in tests]
    bit = {name: 1 << i for i, name in enumerate(own)}
    failed = F.lit(0)
    for name in own:
        failed = failed.bitwiseOR(F.when(F.coalesce(tests[name], F.lit(False)), 0).otherwise(bit[name]))
    always = [t for name, t in tests.items() if name not in bit]
    rows = facts.where(ONCE)
    for test in always:
        rows = rows.where(test)
    rows = rows.withColumn("failed", failed).where(F.bit_count("failed") <= 1)

    def one(block: str, label: Column) -> Column:
        shown = F.col("failed").bitwiseAND(~bit.get(BLOCKS[block], 0)) == 0
        return F.struct(F.lit(block).alias("block"), F.when(shown, label).otherwise("").alias("label"))

    single = F.array(
        one("total", F.lit("all")), *[one(c, F.col(c)) for c in ("country", "employer_country", "industry", "state", "source_type")], one("tier", tier()),
        one("month", F.coalesce(F.date_format(basis(spec.date_basis), "yyyy-MM"), F.lit(""))))
    tags = [F.transform("reason_tags", lambda t: one("reason", t)), F.transform("role_categories", lambda t: one("role", t))]
    rows = rows.select("job_count", "ai_explicit", "source_type", "verification_level", F.explode(F.filter(F.concat(single, *tags), lambda x: x["label"] != "")).alias("x"))
    rows = rows.where("NOT (x.block = 'role' AND x.label = 'unknown')")
    return rows.groupBy("x.block", "x.label").agg(F.count(F.lit(1)).alias("entries"), *measures())


def facet_counts(facts: DataFrame) -> DataFrame:
    """Entries by country, state and industry in one scan."""
    sets = facts.where(ONCE).groupingSets([["country"], ["state"], ["industry"]], "country", "state", "industry").agg(F.count(F.lit(1)).alias("entries"), F.grouping_id().alias("gid"))
    label = F.when(F.col("gid") == 3, F.col("country")).when(F.col("gid") == 5, F.col("state")).otherwise(F.col("industry"))
    facet = F.when(F.col("gid") == 3, "country").when(F.col("gid") == 5, "state").otherwise("industry")
    return sets.select(facet.alias("facet"), label.alias("label"), "entries").where("label <> ''")


def by_tag(facts: DataFrame, column: str) -> DataFrame:
    """Entries and jobs per tag. Tags overlap, so they do not add up to the total."""
    rows = facts.where(ONCE).select("*", F.explode(column).alias("tag")).where("tag <> 'unknown'")
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("entries"), *measures())


def series(facts: DataFrame, date_basis: str, as_of: str) -> DataFrame:
    """Months on a date basis; the to-date measures stop at ``as_of`` and are always on the effective date."""
    day, done = basis(date_basis), F.col("layoff_date") <= F.to_date(F.lit(as_of))
    done = F.coalesce(done, F.lit(False))
    month = F.date_format(day, "yyyy-MM").alias("month")
    out = facts.where(ONCE).where(day.isNotNull()).groupBy(month)
    return out.agg(
        F.count(F.lit(1)).alias("entries"), *measures(), jobs_where(F.col("announced")).alias("announced_jobs"), F.count(F.when(done, 1)).alias("entries_to_date"),
        jobs_where(done).alias("jobs_to_date"), jobs_where(done & F.col("ai_explicit")).alias("ai_jobs_to_date"), jobs_where(done & F.col("announced")).alias("announced_jobs_to_date"),
    )


def repeat_companies(facts: DataFrame, directory: DataFrame | None = None, limit: int = 24) -> DataFrame:
    """Employers with two events or more, memberships included; a directory may give the name shown."""
    out = facts.where("company_key <> ''").groupBy("company_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("job_count").alias("jobs"), F.max_by("company", F.struct("job_count", "id")).alias("company"), F.max("layoff_date").alias("last_date"))
    if directory is not None:
        out = out.join(directory.select("company_key", "display_name"), "company_key", "left").withColumn("company", F.coalesce("display_name", "company")).drop("display_name")
    return out.where("n >= 2").orderBy(F.desc("n"), F.desc("jobs"), "company_key").limit(limit)


def leaders(facts: DataFrame, reports: DataFrame, limit: int = 24) -> DataFrame:
    """The largest entries, memberships included, with their number of reports; the greatest id wins a tie."""
    first = facts.select("id", "company", "job_count", "layoff_date", "country", "event_id").orderBy(F.desc("job_count"), F.desc("id")).limit(limit)
    counts = reports.join(first.select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return first.join(counts, "event_id", "left").select("id", "company", "job_count", "layoff_date", "country", F.coalesce("n", F.lit(0)).alias("reports"))


def period_bounds(period: str, today: str) -> tuple[str | None, str | None]:
    """First and last day of the running week (from Monday), month, quarter or year, or none."""
    import datetime

    day = datetime.date.fromisoformat(today)
    first = {
        "all": None, "week": day - datetime.timedelta(days=day.weekday()), "month": day.replace(day=1),
        "quarter": day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1), "ytd": day.replace(month=1, day=1),
    }[period]
    return (None, None) if first is None else (str(first), today)


def place_board(facts: DataFrame, view: str, period: str, today: str, date_basis: str = "effective", limit: int = 300) -> DataFrame:
    """Verified entries and jobs per country, state, industry or employer's home within a period, and those by artificial intelligence."""
    if view not in ("country", "state", "industry", "employer_country"):
        raise ValueError(f"no view {view}")
    first, last = period_bounds(period, today)
    rows = facts.where(ONCE).where(~F.col("announced")).where(F.col(view) != "")
    if first:
        rows = rows.where(basis(date_basis).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    ai = F.col("ai_explicit")
    out = rows.groupBy(F.col(view).alias("place")).agg(F.count(F.lit(1)).alias("entries"), F.sum("job_count").alias("jobs"), F.count(F.when(ai, 1)).alias("ai_entries"), jobs_where(ai).alias("ai_jobs"))
    return out.orderBy(F.desc("jobs"), F.desc("entries"), "place").limit(limit)


def ranges(facts: DataFrame) -> DataFrame:
    """(what, low, high): the spans that filters offer."""
    out = facts.agg(*[f(c).cast("string").alias(f"{n}_{c}") for c in ("layoff_date", "announcement_date", "job_count") for n, f in (("low", F.min), ("high", F.max))])
    return out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in ("layoff_date", "announcement_date", "job_count")])).alias("x")).select("x.*")


def conversion(facts: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Announced jobs by month and how many of them later entries of the employer confirm within so many months.

    A ranged join: both sides are hashed by employer and bucket of days, the exact range is a residual condition.
    """
    months = max(1, min(24, months))
    anchor = F.coalesce("announcement_date", "layoff_date")
    said = facts.where("announced AND company_key <> ''").where(anchor.isNotNull()).select("id", "company_key", "job_count", anchor.alias("anchor"))
    done = facts.where("NOT announced AND company_key <> '' AND layoff_date IS NOT NULL").select("company_key", F.col("layoff_date").alias("day"), F.col("job_count").alias("confirmed"))
    later = near_days(said.select("id", "company_key", "anchor"), "anchor", done, "day", ["company_key"], 31 * months, before=False).where((F.col("day") > F.col("anchor")) & (F.col("day") <= F.add_months("anchor", months)))
    sums = later.groupBy("id").agg(F.sum("confirmed").alias("after"))
    pairs = said.join(sums, "id", "left").select("id", "anchor", "job_count", F.coalesce("after", F.lit(0)).alias("after"))
    out = pairs.groupBy(F.trunc("anchor", "month").alias("first_day")).agg(
        F.count(F.lit(1)).alias("announcements"), F.sum("job_count").alias("announced_jobs"), F.sum(F.least("job_count", "after")).alias("matched_jobs"))
    now = F.to_date(F.lit(as_of))
    status = F.when(F.add_months("first_day", 1 + months) <= now, "complete").when(F.col("first_day") <= now, "maturing").otherwise("pending")
    return out.select(F.date_format("first_day", "yyyy-MM").alias("month"), "announcements", "announced_jobs", "matched_jobs", percent(F.col("matched_jobs"), F.col("announced_jobs")).alias("pct"), status.alias("status"))


def reconciliation(facts: DataFrame, year: int, limit: int = 60) -> DataFrame:
    """Announced against officially noticed jobs per employer, memberships included; 8-K entries count on neither side."""
    news, notice = F.col("source_type").isin("news", "sec"), F.col("source_type") == "warn"
    out = facts.where((F.year("layoff_date") == year) & (F.col("company_key") != "")).groupBy("company_key").agg(
        F.max_by("company", F.struct("job_count", "id")).alias("company"), jobs_where(news).alias("announced_jobs"), jobs_where(notice).alias("executed_jobs"),
        F.min(F.when(news, F.coalesce("announcement_date", "layoff_date"))).alias("first_announced"), F.min(F.when(notice, F.col("layoff_date"))).alias("first_executed"),
    )
    out = out.where("announced_jobs > 0 AND executed_jobs > 0")
    share = F.round(100 * F.least("executed_jobs", "announced_jobs") / F.col("announced_jobs")).cast("long")
    out = out.withColumns({"coverage_pct": share, "lag_days": F.datediff("first_executed", "first_announced")})
    return out.orderBy(F.desc("announced_jobs"), "company_key").limit(limit)


def notice_gaps(facts: DataFrame) -> DataFrame:
    """Days between filing and effect per state and in all: median, share under 60 days, and what could not be used."""
    gap = F.datediff("layoff_date", "announcement_date")
    used = F.when(gap > 0, gap)
    rows = facts.where("source_type = 'warn' AND superset_of = 0")
    out = rows.rollup("state").agg(
        F.grouping("state").alias("overall"), F.count(used).alias("notices"), F.percentile(used, 0.5).alias("median_days"), F.avg(F.when(used.isNotNull(), (used < 60).cast("int"))).alias("short_share"),
        F.count(F.when(F.col("layoff_date").isNull() | F.col("announcement_date").isNull(), 1)).alias("undated"), F.count(F.when(gap < 0, 1)).alias("reversed"), F.count(F.when(gap == 0, 1)).alias("same_day"),
    )
    return out.select(F.when(F.col("overall") == 1, "ALL").otherwise(F.col("state")).alias("state"), "notices", "median_days", F.round("short_share", 6).alias("short_share"), "undated", "reversed", "same_day")


def period_stats(facts: DataFrame, as_of: str) -> DataFrame:
    """Entries, jobs and employers of the running ISO week, month, quarter, year and of all time."""
    day, now = F.col("layoff_date"), F.to_date(F.lit(as_of))
    spans = F.filter(F.array(
        *[F.when(F.date_trunc(unit, day) == F.date_trunc(unit, now), F.lit(unit)) for unit in ("week", "month", "quarter", "year")], F.lit("all")), lambda x: x.isNotNull())
    rows = facts.where(ONCE).select("*", F.explode(spans).alias("period"))
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("entries"), F.sum("job_count").alias("jobs"), F.count_distinct("company_key").alias("companies"))


def employer_ranking(facts: DataFrame, limit: int = 20) -> DataFrame:
    """Employers by jobs, those that named artificial intelligence apart from those where it was only linked: attributes of the
    largest entry, a missing address or quote filled from the next one that has it."""
    order = F.struct("job_count", "id")
    filled = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", order)).alias(c)
    kind = F.when(F.col("ai_explicit"), "named").when(F.col("ai_causation") == "ai_linked", "mentioned")
    rows = facts.where("superset_of = 0 AND ai_causation <> 'explicitly_denied'").withColumn("kind", kind).where("kind IS NOT NULL AND company_key <> ''")
    out = rows.groupBy("kind", "company_key").agg(
        F.sum("job_count").alias("jobs"), F.max_by("company", order).alias("company"), F.max_by("country", order).alias("country"), filled("source_url"), filled("excerpt"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("jobs"), "company_key"))
    return out.withColumn("rank", nth).where(F.col("rank") <= limit)


def company_page(facts: DataFrame) -> DataFrame:
    """Per employer: totals, first and last date, most common country, state and industry (the first by name on a tie)."""
    rows = facts.where("company_key <> ''")
    by = Window.partitionBy("company_key")

    def mode(column: str) -> DataFrame:
        counts = rows.where(F.col(column) != "").groupBy("company_key", column).agg(F.count(F.lit(1)).alias("n"))
        best = counts.withColumn("nth", F.row_number().over(by.orderBy(F.desc("n"), column))).where("nth = 1")
        return best.select("company_key", F.col(column).alias(f"main_{column}"))

    out = rows.groupBy("company_key").agg(F.count(F.lit(1)).alias("entries"), F.sum("job_count").alias("jobs"), F.min("layoff_date").alias("first_date"), F.max("layoff_date").alias("last_date"))
    for column in ("country", "state", "industry"):
        out = out.join(mode(column), "company_key", "left")
    return out


def timeline(facts: DataFrame, as_of: str) -> DataFrame:
    """Jobs per year; the running year is partial, later years only stay if something in them is done."""
    done = F.col("layoff_date") <= F.to_date(F.lit(as_of))
    out = facts.where(ONCE).where("layoff_date IS NOT NULL").groupBy(F.year("layoff_date").alias("year")).agg(F.sum("job_count").alias("jobs"), jobs_where(done).alias("jobs_to_date"))
    now = int(as_of[:4])
    return out.where((F.col("year") <= now) | (F.col("jobs_to_date") > 0)).withColumn("partial", F.col("year") == now)


def index_buckets(facts: DataFrame) -> DataFrame:
    """Employers by first letter or digit."""
    first = F.upper(F.substring(F.regexp_replace("company_key", "^[^a-z0-9]+", ""), 1, 1))
    bucket = F.when(first.rlike("[A-Z]"), first).when(first.rlike("[0-9]"), "0-9").otherwise("#")
    return facts.where("company_key <> ''").select("company_key", bucket.alias("bucket")).distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("companies"))


def canonical_slugs(directory: DataFrame) -> DataFrame:
    """``directory (company_key, id, slug)``: the shortest slug of each employer, the least id on a tie, with its letter in the index."""
    out = directory.where("slug <> ''").groupBy("company_key").agg(F.min_by("slug", F.struct(F.length("slug"), "id")).alias("slug"))
    first = F.substring("slug", 1, 1)
    return out.withColumn("bucket", F.when(first.rlike("[a-z]"), F.upper(first)).otherwise("0-9"))


def change_log(changes: DataFrame) -> DataFrame:
    """Changes by date, action and reason; jobs stay unknown where any part is unknown."""
    known = F.count("jobs") == F.count(F.lit(1))
    return changes.groupBy("day", "action", "reason").agg(F.count(F.lit(1)).alias("changes"), F.when(known, F.sum("jobs")).alias("jobs"))
