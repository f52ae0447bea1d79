"""Month and week series: gaps, running sums, shares, comparisons, and the early-warning rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import direction, percent, vote


def filled(months: DataFrame, value: str, as_of: str) -> DataFrame:
    """Every month between the first and the last one, none later than ``as_of``; missing values are 0."""
    day = F.to_date(F.concat("month", F.lit("-01")))
    bounds = months.agg(F.min(day).alias("a"), F.least(F.max(day), F.trunc(F.to_date(F.lit(as_of)), "month")).alias("b"))
    every = bounds.where("a <= b").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))
    return every.join(months.select("month", value), "month", "left").select("month", F.coalesce(value, F.lit(0)).alias(value))


def cumulative(months: DataFrame, value: str) -> DataFrame:
    """The running sum from the first month with a value on. One row a month, so one window is small at any scale."""
    run = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.select("month", F.sum(value).over(run).alias("running")).where("running > 0")


def share(months: DataFrame, part: str, whole: str) -> DataFrame:
    return months.select("month", percent(F.col(part), F.col(whole)).alias("pct"))


def year_over_year(months: DataFrame, value: str, years: list[int]) -> DataFrame:
    """One row per month of the year, one column per year."""
    rows = months.select(F.substring("month", 6, 2).alias("month"), F.substring("month", 1, 4).cast("int").alias("year"), value)
    out = rows.groupBy("month").pivot("year", years).agg(F.sum(value))
    return out.select("month", *[F.col(str(y)).alias(f"y{y}") for y in years])


def compare(facts: DataFrame, column: str) -> DataFrame:
    rows = facts.where("superset_of = 0 AND layoff_date IS NOT NULL").where(F.col(column) != "")
    return rows.groupBy(F.date_format("layoff_date", "yyyy-MM").alias("month"), F.col(column).alias("label")).agg(F.sum("job_count").alias("jobs"))


def weekly_to_monthly(weeks: DataFrame, flow: bool = True) -> DataFrame:
    """``weeks (week, value)`` to months: sums of flows, means of stocks; a last month with fewer weeks than the median is cut."""
    out = weeks.groupBy(F.date_format("week", "yyyy-MM").alias("month")).agg((F.sum if flow else F.avg)("value").alias("value"), F.count(F.lit(1)).alias("weeks"))
    limits = out.agg(F.max("month").alias("last"), F.percentile("weeks", 0.5).alias("usual"))
    return out.crossJoin(F.broadcast(limits)).where(~((F.col("month") == F.col("last")) & (F.col("weeks") < F.col("usual")))).select("month", "value", "weeks")


def recent_change(points: DataFrame, recent: int = 3, base: int = 12) -> DataFrame:
    """Mean of the last points of each ``(series, month, value)`` against that of the points before; null where too short."""
    order = Window.partitionBy("series").orderBy(F.desc("month"))
    ranked = points.where("value IS NOT NULL").withColumn("nth", F.row_number().over(order))
    new, old = F.avg(F.when(F.col("nth") <= recent, F.col("value"))), F.avg(F.when(F.col("nth").between(recent + 1, recent + base), F.col("value")))
    out = ranked.groupBy("series").agg(F.max("nth").alias("points"), new.alias("new"), old.alias("old"))
    change = F.when((F.col("points") >= recent + base) & (F.col("old") > 0), F.round(F.col("new") / F.col("old") - 1, 6))
    return out.select("series", "points", change.alias("change")).withColumn("direction", direction(F.col("change")))


def status_vote(changes: DataFrame, group: str) -> DataFrame:
    up, down, judged = (F.count(F.when(c, 1)) for c in (F.col("direction") == "up", F.col("direction") == "down", F.col("direction").isNotNull()))
    out = changes.groupBy(group).agg(up.alias("up"), down.alias("down"), judged.alias("judged"))
    return out.withColumn("status", vote(F.col("up"), F.col("down"), F.col("judged")))


def indexed(points: DataFrame) -> DataFrame:
    """Each series against its own mean as 100."""
    mean = F.avg("value").over(Window.partitionBy("series"))
    return points.select("series", "month", F.round(100 * F.col("value") / mean, 6).alias("indexed"))


def same_quarter_change(quarters: DataFrame) -> DataFrame:
    """The latest ``(series, year, quarter, value)`` against the same quarter a year before."""
    last = quarters.groupBy("series").agg(F.max_by(F.struct("year", "quarter", "value"), F.struct("year", "quarter")).alias("x")).select("series", "x.*")
    before = quarters.select("series", (F.col("year") + 1).alias("year"), "quarter", F.col("value").alias("before"))
    out = last.join(before, ["series", "year", "quarter"], "left")
    return out.select("series", "year", "quarter", F.when(F.col("before") > 0, F.round(F.col("value") / F.col("before") - 1, 6)).alias("change"))
