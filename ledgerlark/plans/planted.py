"""Rows derived from the ledger for queries that need repeats: the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ledger as tables

SHIFT = 50_000_000
KINDS = ("news", "warn", "erm", "8K")


def pick(values: list, k: str = "id") -> str:
    """SQL for the value at a row's place, round and round."""
    return "[" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values) + f"][({k}) % {len(values)} + 1]"


def picked(values: list, k: str = "id"):
    """The same as a column."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(k) % len(values) + 1).cast("int"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, and of every third row a repeat with the same employer, count and address, up to 400 days later, from another source and stage."""
    facts = tables.ledger(spark, sf_dir)
    days = (F.col("id") % 11 * 40).cast("int")
    copies = facts.where("id % 3 = 0").withColumns({
        "source_type": picked(list(KINDS), "id % 7"), "announced": ~F.col("announced"), "edited": F.lit(False), "superset_of": F.lit(0).cast("long"),
        "layoff_date": F.date_add("layoff_date", days), "event_id": F.col("event_id") + SHIFT, "source_url": F.when(F.col("id") % 4 == 0, F.concat("source_url", F.lit("?again"))).otherwise(F.col("source_url")), "id": F.col("id") + SHIFT,
    })
    return facts.unionByName(copies)


PLANTED_SQL = f""", planted AS (SELECT * FROM ledger UNION ALL SELECT * REPLACE (id + {SHIFT} AS id, {pick(list(KINDS), 'id % 7')} AS source_type, NOT announced AS announced, FALSE AS edited, CAST(0 AS BIGINT) AS superset_of,
  layoff_date + CAST(id % 11 * 40 AS INTEGER) AS layoff_date, event_id + {SHIFT} AS event_id, CASE WHEN id % 4 = 0 THEN source_url || '?again' ELSE source_url END AS source_url) FROM ledger WHERE id % 3 = 0)"""
