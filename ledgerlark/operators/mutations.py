"""Changes as rewrites of snapshots: every function takes tables and returns the tables that replace them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise
from ..functions.employers import is_anonymous

#: Columns that a blank incoming value leaves as they are.
STICKY = ("industry", "announcement_date", "excerpt", "source_url")


def upsert(existing: DataFrame, incoming: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """``existing`` with ``incoming`` entries put in by digest.

    Suppressed digests and anonymous employers are skipped, edited entries never touched, blanks do not overwrite. Of several
    incoming rows with one digest the one with the greatest id counts. Applying it twice changes nothing more.
    """
    new = incoming.where(~is_anonymous(F.col("company")))
    if suppressed is not None:
        new = new.join(suppressed.select("dedup_hash"), "dedup_hash", "left_anti")
    newest = Window.partitionBy("dedup_hash").orderBy(F.desc("id"))
    new = new.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
    columns = existing.columns
    old = existing.select(*[F.col(c).alias(f"_{c}") for c in columns])
    both = old.join(new, F.col("_dedup_hash") == F.col("dedup_hash"), "full")

    def merged(c: str) -> Column:
        if c in ("id", "event_id"):
            return F.coalesce(f"_{c}", c)
        fresh = F.when(F.col(c).cast("string") != "", F.col(c)) if c in STICKY else F.col(c)
        value = F.coalesce(fresh, F.col(f"_{c}"), F.col(c)) if c in STICKY else fresh
        return F.when(F.col("dedup_hash").isNull() | F.coalesce("_edited", F.lit(False)), F.col(f"_{c}")).otherwise(value)

    return both.select(*[merged(c).alias(c) for c in columns])


def register(known: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Append every incoming row whose key is not known; incoming rows that share a new key all come in, as whole rows."""
    return known.unionByName(incoming.join(known.select(key), key, "left_anti").select(*known.columns))


def merge_events(facts: DataFrame, reports: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``merges (keep_id, drop_id)``: dropped rows go, their evidence moves to the kept row's event, their digests are suppressed."""
    pairs = merges.join(facts.select(F.col("id").alias("keep_id"), F.col("event_id").alias("to")), "keep_id").join(facts.select(F.col("id").alias("drop_id"), F.col("event_id").alias("from"), "dedup_hash"), "drop_id")
    moves = pairs.groupBy(F.col("from").alias("event_id")).agg(F.min("to").alias("to"))
    moved = reports.join(moves, "event_id", "left").withColumn("event_id", F.coalesce("to", "event_id")).drop("to")
    return facts.join(pairs.select(F.col("drop_id").alias("id")), "id", "left_anti").select(*facts.columns), moved.select(*reports.columns), pairs.select("dedup_hash").distinct()


def purge_notices(facts: DataFrame) -> DataFrame:
    return facts.where("NOT (source_type = 'warn' AND NOT edited)")


def plausible_dates(facts: DataFrame, as_of: str, first_year: int = 2000, months: int = 36) -> DataFrame:
    """Dates before a year or too far ahead become null, as an entry is put in; ``cleaned_dates`` has the tighter bounds of the cleanup."""
    last = F.add_months(F.to_date(F.lit(as_of)), months)
    keep = lambda c: F.when((F.year(c) >= first_year) & (F.col(c) <= last), F.col(c)).alias(c)
    return facts.select(*[keep(c) if c in ("layoff_date", "announcement_date") else F.col(c) for c in facts.columns])


def cleaned_dates(facts: DataFrame, as_of: str) -> DataFrame:
    """Dates that the cleanup of stored entries lets stand: from 2015 on, and up to 18 months ahead."""
    return plausible_dates(facts, as_of, 2015, 18)


def key_drift(facts: DataFrame, derive) -> DataFrame:
    """Entries whose stored identity key is not what the name gives now."""
    return facts.select("id", F.col("company_key").alias("was"), derive(F.col("company")).alias("now")).where("was <> now")


def propagate_industry(facts: DataFrame) -> DataFrame:
    """Blank industries filled where all other entries of the employer agree."""
    agreed = facts.where("industry <> '' AND company_key <> ''").groupBy("company_key").agg(F.count_distinct("industry").alias("n"), F.min("industry").alias("agreed")).where("n = 1")
    return facts.where("industry = ''").join(agreed, "company_key").select("id", F.col("agreed").alias("industry"))


def state_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``(id, value)`` that differ between two snapshots."""
    out = before.select("id", F.col("value").alias("was")).join(after.select("id", F.col("value").alias("now")), "id", "full")
    return out.where(~F.col("was").eqNullSafe(F.col("now")))


def newest_slots(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Union of two slot maps ``(slot, updated, status)``, the newer one of each slot; ours on a tie."""
    both = ours.withColumn("own", F.lit(1)).unionByName(theirs.withColumn("own", F.lit(0)))
    return both.groupBy("slot").agg(F.max_by(F.struct("updated", "status"), F.struct("updated", "own")).alias("x")).select("slot", "x.*")


def trashed(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries without those of ``ids (id)``."""
    return facts.join(ids.select("id").distinct(), "id", "left_anti").select(*facts.columns)


def edited(facts: DataFrame, values: DataFrame) -> DataFrame:
    """The entries with the columns of ``values (id, ...)`` put in, one row per id, and marked as edited; nulls change nothing."""
    columns = [c for c in values.columns if c != "id"]
    new = values.dropDuplicates(["id"]).select("id", F.lit(True).alias("_by_hand"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = facts.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    return out.withColumn("edited", F.col("edited") | F.coalesce("_by_hand", F.lit(False))).select(*facts.columns)


def normalised_column(facts: DataFrame, column: str) -> DataFrame:
    """The entries with a column's values normalised; only the distinct values are, and then looked up."""
    kernel = {"country": normalise.country, "employer_country": normalise.country, "industry": normalise.industry, "state": normalise.state}[column]
    values = facts.select(F.col(column).alias("_was")).distinct().withColumn("_now", kernel(F.col("_was")))
    return facts.join(values, F.col(column).eqNullSafe(F.col("_was")), "left").withColumn(column, F.col("_now")).select(*facts.columns)
