"""Pages, queues and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SORTABLE = ("layoff_date", "job_count", "company", "country", "state", "industry")


def default_page(facts: DataFrame, as_of: str, page: int = 1, per_page: int = 50, sort: str = "layoff_date", descending: bool = True) -> DataFrame:
    """A page by one of the sortable columns, the greatest id first on ties. By day, undated rows come last and, newest first, those still to come after the past ones."""
    if sort not in SORTABLE:
        raise ValueError(f"not sortable: {sort}")
    value = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    later = [F.col("layoff_date") > F.to_date(F.lit(as_of))] if sort == "layoff_date" and descending else []
    order = [F.col(sort).isNull(), *later, value, F.desc("id")]
    return facts.orderBy(*order).offset((page - 1) * per_page).limit(max(1, min(200, per_page)))


def changed_after(facts: DataFrame, cursor: tuple[str, int] | None, n: int = 200) -> DataFrame:
    """The next rows by (change time, id) after a cursor, with one more row as a sign that there are others."""
    rows = facts
    if cursor:
        at, last = F.lit(cursor[0]).cast("timestamp_ntz"), cursor[1]
        rows = rows.where((F.col("updated_at") > at) | ((F.col("updated_at") == at) & (F.col("id") > last)))
    return rows.orderBy("updated_at", "id").limit(n + 1)


def review_queue(facts: DataFrame, reports: DataFrame, jobs: int = 5000, limit: int = 100) -> DataFrame:
    """Entries to be looked at, with the reasons why and how many reports are kept of each."""
    why = F.array_compact(F.array(
        F.when(F.col("job_count") >= jobs, "very_large_event"), F.when(F.col("ai_causation") == "primary_cause", "ai_primary_claim"), F.when(F.col("country") == "Multiple countries", "multi_country_event")))
    first = facts.select("id", "event_id", "job_count", F.array_join(why, ",").alias("triggers")).where("triggers <> ''").orderBy(F.desc("job_count"), F.desc("id")).limit(limit)
    kept = reports.join(first.select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return first.join(kept, "event_id", "left").select("id", "job_count", "triggers", F.coalesce("n", F.lit(0)).alias("reports"))


def typeahead(facts: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Employers whose name has the term, those that begin with it first, then the most recent."""
    low = F.lower("company")
    rows = facts.where(F.contains(low, F.lit(term.lower()))).groupBy("company").agg(F.max("layoff_date").alias("last_date"), F.count(F.lit(1)).alias("entries"))
    return rows.orderBy(F.desc(F.startswith(F.lower("company"), F.lit(term.lower()))), F.col("last_date").desc_nulls_last(), "company").limit(limit)
