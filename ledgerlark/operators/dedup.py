"""Event deduplication: which entries are parts or repeats of which other.

``reconcile`` applies the passes in their fixed order; an entry keeps the first mark it gets. Within a pass, the order of ids decides.
Every pass is a join or window on a key, so no pass gathers more than one employer's or one count's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.employers import company_key, same_employer, without_revision_mark
from ..plans.lineage import cut
from .components import connected_components
from .reconcile import bucket_key, near_days

NEWS = ("news", "erm", "8K", "press_release")
MAX_WINDOW = 200


def candidates(facts: DataFrame) -> DataFrame:
    return facts.where("company_key <> '' AND job_count > 0 AND NOT edited")


def window_marks(facts: DataFrame, days: int = 45, share: float = 0.5, least: int = 200) -> DataFrame:
    """Pass 1, (member, primary): news totals against the official notices of the employer around the day.

    A total of at least the notices' sum takes them in; one of at least half of it becomes part of the largest notice.
    """
    if not 0 < days <= MAX_WINDOW:
        raise ValueError(f"a window of {days} days is no scope for a sum")
    rows = candidates(facts).where("layoff_date IS NOT NULL")
    news = rows.where(F.col("source_type").isin(*NEWS) & (F.col("job_count") >= least)).select(F.col("id").alias("news_id"), "company_key", F.col("job_count").alias("total"), F.col("layoff_date").alias("day"))
    notices = rows.where("source_type = 'warn'").select(F.col("id").alias("notice_id"), "company_key", "job_count", "layoff_date")
    near = near_days(news, "day", notices, "layoff_date", ["company_key"], days)
    sums = near.groupBy("news_id", "total").agg(F.sum("job_count").alias("sum"), F.max_by("notice_id", F.struct("job_count", -F.col("notice_id"))).alias("largest"))
    judged = sums.where(F.col("total") >= share * F.col("sum"))
    taken = near.join(judged.where("total >= sum").select("news_id"), "news_id", "left_semi").groupBy(F.col("notice_id").alias("member")).agg(F.min("news_id").alias("primary"))
    part = judged.where("total < sum").select(F.col("news_id").alias("member"), F.col("largest").alias("primary"))
    return taken.unionByName(part)


def same_count_marks(facts: DataFrame, days: int = 150) -> DataFrame:
    """Pass 2: news of one employer with one count, within so many days of the first (AI evidence, then day, then id)."""
    rows = candidates(facts).where(F.col("source_type").isin(*NEWS) & F.col("layoff_date").isNotNull())
    order = Window.partitionBy("company_key", "job_count").orderBy(F.desc("ai_explicit"), "layoff_date", "id")
    rows = rows.select("id", "layoff_date", F.first("id").over(order).alias("primary"), F.first("layoff_date").over(order).alias("first_day"))
    return rows.where((F.col("id") != F.col("primary")) & (F.abs(F.datediff("layoff_date", "first_day")) <= days)).select(F.col("id").alias("member"), "primary")


def alias_marks(facts: DataFrame, days: int = 2, least: int = 100) -> DataFrame:
    """Pass 3: one count within two days under two names of one employer; components, named by their first entry."""
    rows = candidates(facts).where(F.col("layoff_date").isNotNull() & (F.lower("source_type") != "warn") & (F.col("job_count") >= least))
    rows = rows.select("id", "company", "company_key", "job_count", "layoff_date", "ai_explicit")
    a = rows.select("job_count", *[F.col(c).alias(f"a_{c}") for c in rows.columns if c != "job_count"])
    same = same_employer(F.col("a_company_key"), F.col("company_key"), F.col("a_company"), F.col("company"))
    links = near_days(a, "a_layoff_date", rows, "layoff_date", ["job_count"], days).where("a_id < id").where(same).select(F.col("a_id").alias("a"), F.col("id").alias("b"))
    placed = connected_components(links).withColumnRenamed("node", "id").join(rows, "id")
    first = placed.groupBy("component").agg(F.min_by("id", F.struct(~F.col("ai_explicit"), "layoff_date", "id")).alias("primary"))
    return placed.join(first, "component").where("id <> primary").select(F.col("id").alias("member"), "primary")


def revision_marks(facts: DataFrame, days: int = 90, least: int = 100) -> DataFrame:
    """Pass 4: notices published again under a revised name; the earliest one stays."""
    rows = candidates(facts).where(F.col("source_type") == "warn").where(F.col("layoff_date").isNotNull() & (F.col("job_count") >= least))
    rows = rows.withColumn("revision_key", company_key(without_revision_mark(F.col("company"))))
    order = Window.partitionBy("revision_key", "state", "job_count").orderBy("layoff_date", "id")
    rows = rows.select("id", "layoff_date", F.first("id").over(order).alias("primary"), F.first("layoff_date").over(order).alias("first_day"))
    return rows.where((F.col("id") != F.col("primary")) & (F.datediff("layoff_date", "first_day") <= days)).select(F.col("id").alias("member"), "primary")


def declared_marks(marks: DataFrame, declared: DataFrame, facts: DataFrame) -> DataFrame:
    """Pass 5: declared memberships win; those with missing rows or chains are released, marks on declared members move on."""
    ids = facts.select(F.col("id"))
    valid = declared.select("member", "primary").join(ids.select(F.col("id").alias("member")), "member", "left_semi").join(ids.select(F.col("id").alias("primary")), "primary", "left_semi")
    valid = valid.join(valid.select(F.col("member").alias("primary")), "primary", "left_anti")
    others = marks.join(valid.select("member"), "member", "left_anti").join(valid.select(F.col("primary").alias("member")), "member", "left_anti")
    moved = others.join(valid.select(F.col("member").alias("primary"), F.col("primary").alias("to")), "primary", "left")
    return valid.unionByName(moved.select("member", F.coalesce("to", "primary").alias("primary")).where("member <> primary"))


def reconcile(facts: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(member, primary) of all passes. Marked entries take no part in later passes."""
    # Entries that no pass takes are left out at once, and what the passes read is derived once, not by each of them.
    rows = cut(candidates(facts).where("layoff_date IS NOT NULL").select("id", "company", "company_key", "job_count", "layoff_date", "source_type", "ai_explicit", "state", "edited"))
    marks = cut(window_marks(rows))
    for find in (same_count_marks, alias_marks, revision_marks):
        rest = rows.join(marks.select(F.col("member").alias("id")), "id", "left_anti")
        marks = cut(marks.unionByName(find(rest)))
    return declared_marks(marks, declared, facts) if declared is not None else marks


def reconcile_report(facts: DataFrame, marks: DataFrame) -> DataFrame:
    """What changes when the marks replace the present memberships: id, was, now."""
    now = facts.select("id", F.col("superset_of").alias("was")).join(marks.select(F.col("member").alias("id"), F.col("primary").alias("now")), "id", "left")
    return now.select("id", "was", F.coalesce("now", F.lit(0).cast("long")).alias("now")).where("was <> now")


def gap_clusters(facts: DataFrame, days: int = 30) -> DataFrame:
    """Runs of an employer's entries with no gap of more than so many days, official notices apart; the best verified, then largest entry stays.

    An entry that stays without a quote on artificial intelligence inherits the best member's one. A run is found by its gaps
    alone, so the window orders an employer's days, not its entries: however many entries it has, they are counted per day first.
    """
    rows = facts.where("company_key <> '' AND layoff_date IS NOT NULL AND source_type <> 'warn'")
    per_day = rows.select("company_key", "layoff_date").distinct()
    order = Window.partitionBy("company_key").orderBy("layoff_date")
    gap = F.datediff("layoff_date", F.lag("layoff_date").over(order))
    days_of = per_day.withColumn("cluster", F.sum(F.when(gap > days, 1).otherwise(0)).over(order))
    rows = rows.join(days_of, ["company_key", "layoff_date"])
    rank = F.when(F.col("verification_level") == "gold", 3).when(F.col("verification_level") == "silver", 2).when(F.col("verification_level") == "bronze", 1).otherwise(0)
    order_of = F.struct(-rank, -F.col("job_count"), F.col("id"))
    told = F.col("ai_explicit") & (F.col("excerpt") != "")
    groups = rows.groupBy("company_key", "cluster").agg(F.min_by("id", order_of).alias("keeper_id"), F.min_by(F.when(told, F.col("excerpt")), F.when(told, order_of)).alias("ai_quote"))
    out = rows.select("id", "company_key", "cluster", "ai_explicit").join(groups, ["company_key", "cluster"])
    keeper = F.col("id") == F.col("keeper_id")
    return out.select("id", "company_key", "cluster", keeper.alias("keeper"), F.when(keeper & ~F.col("ai_explicit"), F.col("ai_quote")).alias("inherited_quote"))


def article_duplicates(facts: DataFrame) -> DataFrame:
    """One article, one number, several events: what is counted too often."""
    groups = facts.where("source_url <> '' AND superset_of = 0").groupBy("source_url", "job_count").agg(F.count_distinct("event_id").alias("events"))
    return groups.where("events > 1").select("source_url", "job_count", "events", (F.col("job_count") * (F.col("events") - 1)).alias("excess"))


def shape_pairs(facts: DataFrame, ratio: float = 0.98, days: int = 30, least: int = 1000) -> DataFrame:
    """Pairs of nearly equal counts within days in one country, whatever the names.

    There is no equal key, so counts are put into logarithmic buckets as wide as the ratio, days into buckets of the window, and
    each row meets its own and the neighbouring buckets; the exact test is a residual.
    """
    rows = facts.where(f"layoff_date IS NOT NULL AND superset_of = 0 AND job_count >= {least}").select("id", "event_id", "job_count", "layoff_date", "country", "source_type")
    size = F.floor(F.log("job_count") / -F.log(F.lit(ratio)))
    span = F.floor(F.datediff("layoff_date", F.lit("1970-01-01").cast("date")) / days)
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns], size.alias("size"), span.alias("span"))
    b = rows.select("*", F.explode(F.array(size - 1, size, size + 1)).alias("size"), span.alias("_span")).select("*", F.explode(F.array(F.col("_span") - 1, F.col("_span"), F.col("_span") + 1)).alias("span"))
    low, high = F.least("a_job_count", "job_count"), F.greatest("a_job_count", "job_count")
    test = (F.col("a_id") < F.col("id")) & (F.col("a_event_id") != F.col("event_id")) & (low >= ratio * high) & (F.abs(F.datediff("a_layoff_date", "layoff_date")) <= days)
    test &= ~((F.col("a_source_type") == "warn") & (F.col("source_type") == "warn"))
    # Equal countries are a part of the key; only rows without one meet all others of their buckets.
    here = a.withColumn("country", F.col("a_country")).join(b, ["size", "span", "country"])
    blank = a.join(b.where("country = ''"), ["size", "span"]).where("a_country <> ''").select(*here.columns).unionByName(a.where("a_country = ''").join(b.where("country <> ''"), ["size", "span"]).select(*here.columns))
    return here.unionByName(blank).where(test).select(F.col("a_id").alias("first_id"), F.col("id").alias("second_id"), "a_job_count", "job_count")


def cross_date_hash(company, day, jobs):
    """The digest that tells an entry apart from all others."""
    return F.md5(F.concat(F.lower(F.trim(company)), F.coalesce(day.cast("string"), F.lit("")), jobs.cast("string")))


class _Cluster:
    """A cluster of the walk below: its members by count, and the first and last day of all, and of those too small for the wider windows."""

    __slots__ = ("all", "close", "days", "jobs", "name", "place", "same")

    def __init__(self, name: int, jobs: int, day: int, place: str):
        self.name, self.place, self.jobs, self.days = name, place, [jobs], [day]
        # (first day, last day, number of members) of all, of those below 99.5 % and of those below 95 % of the present count.
        self.all, self.same, self.close = (day, day), (1 << 40, -(1 << 40), 0), (1 << 40, -(1 << 40), 0)

    def below(self, span: tuple[int, int, int], share: float, jobs: int) -> tuple[int, int, int]:
        low, high, k = span
        while k < len(self.jobs) and self.jobs[k] / jobs < share:
            low, high, k = min(low, self.days[k]), max(high, self.days[k]), k + 1
        return low, high, k

    def fits(self, jobs: int, day: int, place: str) -> bool:
        """Whether a row of at least the greatest count so far fits all members; every window is wide enough for the members with wider ones."""
        if place and self.place and place != self.place:
            return False
        low, high = self.all
        if jobs < 100:
            return high - 120 <= day <= low + 120
        if not high - 1095 <= day <= low + 1095:
            return False
        self.same = low, high, _ = self.below(self.same, 0.995, jobs)
        days = 365 if jobs >= 1000 else 120
        if not high - days <= day <= low + days:
            return False
        if jobs < 1000:
            return True
        self.close = low, high, _ = self.below(self.close, 0.95, jobs)
        return high - 120 <= day <= low + 120

    def add(self, jobs: int, day: int, place: str) -> None:
        self.all, self.place = (min(self.all[0], day), max(self.all[1], day)), self.place or place
        self.jobs.append(jobs)
        self.days.append(day)


def _walk(batches):
    """Cluster names for batches of rows ordered by (bucket, count, day, id); open clusters are all that is held."""
    import pyarrow as pa

    bucket, open_clusters, last, seen = None, [], None, {}
    for batch in batches:
        ids, named = batch.column("id").to_pylist(), []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "job_count", "day", "place"))
        for i, own, jobs, day, place in zip(ids, *columns, strict=True):
            if own != bucket:
                bucket, open_clusters, last = own, [], None
            if (jobs, day) != last:
                last, seen = (jobs, day), {}
                # Counts only grow, so a cluster whose first member is too small is never joined again; the first ones are the smallest.
                dead = 0
                while dead < len(open_clusters) and open_clusters[dead].jobs[0] / jobs < 0.75:
                    dead += 1
                del open_clusters[:dead]
            # A row with the count, day and place of one before it joins where that one did.
            if place not in seen:
                for found in open_clusters:
                    if found.fits(jobs, day, place):
                        found.add(jobs, day, place)
                        break
                else:
                    found = _Cluster(i, jobs, day, place)
                    open_clusters.append(found)
                seen[place] = found.name
            named.append(seen[place])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("bucket"), pa.array(named, pa.int64())], ["id", "bucket", "cluster"])


def greedy_clusters(facts: DataFrame) -> DataFrame:
    """Clusters of one employer's rows, taken by (count, day, id): a row joins the first cluster all of whose members it fits.

    Rows fit if the smaller count is at least three quarters of the larger and the days are near: three years for equal counts
    from 100 on, one year for nearly equal ones from 1000 on, else 120 days; known countries must agree. The order decides, so an
    employer's rows are walked in one task, but as a stream: rows come sorted, and what is held is the clusters whose first count is
    not yet a quarter smaller, each with the days that bound it. A cluster is named by its least row.
    """
    place = F.lower(F.trim("country"))
    place = F.coalesce(F.when(place.isin("unknown", "multiple countries", "world", "worldwide"), "").otherwise(place), F.lit(""))
    day = F.datediff("layoff_date", F.lit("1970-01-01").cast("date"))
    rows = facts.where("layoff_date IS NOT NULL AND job_count > 0 AND source_type <> 'federal_rif'").select("id", bucket_key(F.col("company")).alias("bucket"), "job_count", day.alias("day"), place.alias("place")).where("bucket <> ''")
    walked = rows.repartition("bucket").sortWithinPartitions("bucket", "job_count", "day", "id")
    return walked.mapInArrow(_walk, "id long, bucket string, cluster long")
