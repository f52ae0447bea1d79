"""The event ledger and its side tables, derived from the shared star schema.

Every column is a fixed function of keys, so the same rows come out of any engine. Texts that are missing are empty strings;
only dates are null. ``LEDGER_SQL`` states the same views as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The controlled vocabularies of the ledger.
REASON_TAGS = ("cost_reduction", "restructuring", "closure", "ai_automation", "bankruptcy")
AI_CAUSES = ("primary_cause", "contributing_cause", "ai_linked", "selection_or_operations", "context_only", "explicitly_denied", "unknown")
SOURCE_TYPES = {"1-URGENT": "8K", "2-HIGH": "warn", "3-MEDIUM": "news", "4-NOT SPECIFIED": "press_release", "5-LOW": "erm"}
AS_OF = "2000-06-30"

FACT_SCHEMA = (
    "id long, company string, company_key string, ticker string, job_count long, layoff_date date, announcement_date date, industry string, country string, "
    "employer_country string, state string, source_type string, verification_level string, source_name string, source_url string, ai_explicit boolean, "
    "ai_causation string, confidence int, review_status string, announced boolean, edited boolean, reason_tags array<string>, role_categories array<string>, "
    "excerpt string, event_id long, superset_of long, updated_at timestamp_ntz, dedup_hash string"
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def company_key():
    """The employer's key, of a row of :func:`sourced`."""
    return F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", " "))


def layoff_date():
    """The effective date, of a row of :func:`sourced`."""
    k = F.col("o_orderkey")
    return F.when(k % 37 != 0, F.date_add(F.col("o_orderdate").cast("date"), (k % 90).cast("int")))


def sourced(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders beside their customers: the few short columns that the ledger's rows are derived from."""
    rows = (read(spark, sf_dir, "orders") if orders is None else orders).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_name", "c_nationkey", "c_mktsegment")


def keyed(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of :func:`sourced` with their nations, employer's key and effective date. Nations are of fixed number and broadcast, so that rows stay where they are."""
    nation = read(spark, sf_dir, "nation")
    home = nation.select(F.col("n_nationkey").alias("home_key"), F.col("n_name").alias("home_name"))
    rows = rows.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(home), F.col("o_orderkey") % 25 == F.col("home_key"))
    return rows.withColumns({"company_key": company_key(), "layoff_date": layoff_date()})


def ledger(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One reported event per row, of all orders or of those given (a stream of them too). Customers are joined by key as the optimiser sees fit."""
    return derived(keyed(spark, sf_dir, sourced(spark, sf_dir, orders)))


def derived(rows: DataFrame, *more: str) -> DataFrame:
    """The ledger of :func:`keyed` rows, and the columns ``more`` of theirs; each row by itself, so rows stay where they are."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    types = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    kind = types[F.col("o_orderpriority")]
    tags = F.filter(F.array(*[F.when(k % m == 0, F.lit(t)) for m, t in zip((2, 3, 5, 7, 11), REASON_TAGS, strict=True)]), lambda x: x.isNotNull())
    roles = F.filter(F.array(F.when(k % 2 == 0, F.lit("engineering")), F.when(k % 3 == 0, F.lit("sales_marketing")), F.when(k % 13 == 0, F.lit("unknown"))), lambda x: x.isNotNull())
    jobs = F.floor(F.col("o_totalprice") / 100).cast("long")
    place = F.when(F.col("n_regionkey") == 1, F.concat(F.char(65 + k % 5), F.char(65 + k % 7))).otherwise("")
    return rows.select(
        (k + 1).alias("id"), F.col("c_name").alias("company"), "company_key",
        F.when(k % 9 == 0, F.concat(F.lit("T"), F.col("o_custkey"))).otherwise("").alias("ticker"), jobs.alias("job_count"),
        "layoff_date", F.when(k % 5 != 0, day).alias("announcement_date"),
        F.when(k % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("industry"), F.col("n_name").alias("country"),
        F.when(k % 4 == 0, "").otherwise(F.col("home_name")).alias("employer_country"), place.alias("state"), kind.alias("source_type"),
        F.when(kind == "warn", "warn").when(kind == "8K", F.when(k % 10 == 0, "bronze").otherwise("gold")).when(k % 3 == 0, "bronze").otherwise("silver").alias("verification_level"),
        F.concat(F.lit("desk "), k % 20).alias("source_name"),
        F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("https://news"), k % 50, F.lit(".example.org/a/"), k % 4000)).alias("source_url"),
        (k % 7 == 0).alias("ai_explicit"), F.element_at(F.array(*map(F.lit, AI_CAUSES)), (k % 7 + 1).cast("int")).alias("ai_causation"), (k % 101).cast("int").alias("confidence"),
        F.element_at(F.array(F.lit("pending"), F.lit("approved"), F.lit("rejected")), (k % 3 + 1).cast("int")).alias("review_status"),
        (F.col("o_orderstatus") == "P").alias("announced"), (k % 17 == 0).alias("edited"), tags.alias("reason_tags"), roles.alias("role_categories"),
        F.concat(F.lit("Notice of "), jobs, F.lit(" jobs at "), F.col("c_name"), F.lit(" in "), F.col("n_name")).alias("excerpt"),
        (k + 1).cast("long").alias("_id1"), F.when(k % 13 == 0, k + 2).otherwise(F.lit(0).cast("long")).alias("superset_of"),
        F.col("o_orderdate").alias("updated_at"), F.md5(F.concat_ws("|", "c_name", day.cast("string"), jobs.cast("string"))).alias("dedup_hash"), *more,
    ).withColumn("event_id", F.floor(F.col("_id1") / 2)).drop("_id1")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence reports: one per line item, on the order's event."""
    k = F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select(
        F.floor((k + 1) / 2).alias("event_id"), F.concat(F.lit("wire "), F.col("l_suppkey") % 12).alias("source_name"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("https://wire"), F.col("l_suppkey") % 12, F.lit(".example.org/r/"), F.col("l_partkey"))).alias("source_url"),
        F.col("l_shipdate").alias("observed_at"), F.col("l_linenumber").cast("long").alias("line"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events: the least member is canonical, except that every ninth event points at a row that is gone."""
    e = ledger(spark, sf_dir).groupBy("event_id").agg(F.min("id").alias("least"))
    return e.select("event_id", F.when(F.col("event_id") % 9 == 0, -F.col("event_id") - 1).otherwise(F.col("least")).alias("canonical_id"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL snapshots of two thirds of the addresses."""
    urls = ledger(spark, sf_dir).where("source_url <> ''").groupBy("source_url").agg(F.min("id").alias("id"))
    n = F.col("id") % 3
    return urls.where(n != 0).select(F.md5(F.trim("source_url")).alias("url_hash"), F.when(n == 1, "archived").otherwise("pending").alias("status"), (F.col("id") % 5).alias("attempts"))


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collector telemetry: one run per event row."""
    n = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        n.alias("id"), F.col("event_type").alias("source"), F.when(n % 10 == 0, "degraded").when(n % 10 < 3, "running").otherwise("ok").alias("status"),
        F.when(n % 4 == 0, F.lit(0)).otherwise(F.floor("value")).cast("long").alias("entries"), F.col("ts").alias("attempted_at"), F.col("user_id").alias("worker"),
    )


LEDGER_SQL = """
ledger AS (
  SELECT o_orderkey + 1 AS id, c_name AS company, lower(regexp_replace(c_name, '[^A-Za-z0-9]', ' ', 'g')) AS company_key,
    CASE WHEN o_orderkey % 9 = 0 THEN 'T' || o_custkey ELSE '' END AS ticker, CAST(floor(o_totalprice / 100) AS BIGINT) AS job_count,
    CASE WHEN o_orderkey % 37 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS layoff_date,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS announcement_date,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE c_mktsegment END AS industry, n.n_name AS country,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE h.n_name END AS employer_country,
    CASE WHEN n.n_regionkey = 1 THEN chr(CAST(65 + o_orderkey % 5 AS INTEGER)) || chr(CAST(65 + o_orderkey % 7 AS INTEGER)) ELSE '' END AS state,
    kind AS source_type,
    CASE WHEN kind = 'warn' THEN 'warn' WHEN kind = '8K' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'bronze' ELSE 'gold' END
         WHEN o_orderkey % 3 = 0 THEN 'bronze' ELSE 'silver' END AS verification_level,
    'desk ' || (o_orderkey % 20) AS source_name,
    CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'https://news' || (o_orderkey % 50) || '.example.org/a/' || (o_orderkey % 4000) END AS source_url,
    o_orderkey % 7 = 0 AS ai_explicit,
    ['primary_cause', 'contributing_cause', 'ai_linked', 'selection_or_operations', 'context_only', 'explicitly_denied', 'unknown'][o_orderkey % 7 + 1] AS ai_causation,
    CAST(o_orderkey % 101 AS INTEGER) AS confidence, ['pending', 'approved', 'rejected'][o_orderkey % 3 + 1] AS review_status,
    o_orderstatus = 'P' AS announced, o_orderkey % 17 = 0 AS edited,
    list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'cost_reduction' END, CASE WHEN o_orderkey % 3 = 0 THEN 'restructuring' END, CASE WHEN o_orderkey % 5 = 0 THEN 'closure' END,
      CASE WHEN o_orderkey % 7 = 0 THEN 'ai_automation' END, CASE WHEN o_orderkey % 11 = 0 THEN 'bankruptcy' END], lambda x: x IS NOT NULL) AS reason_tags,
    list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'engineering' END, CASE WHEN o_orderkey % 3 = 0 THEN 'sales_marketing' END, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' END], lambda x: x IS NOT NULL) AS role_categories,
    'Notice of ' || CAST(floor(o_totalprice / 100) AS BIGINT) || ' jobs at ' || c_name || ' in ' || n.n_name AS excerpt,
    (o_orderkey + 1) // 2 AS event_id, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 2 ELSE 0 END AS superset_of,
    o_orderdate AS updated_at, md5(c_name || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|' || CAST(floor(o_totalprice / 100) AS BIGINT)) AS dedup_hash
  FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN '8K' WHEN '2-HIGH' THEN 'warn' WHEN '3-MEDIUM' THEN 'news' WHEN '4-NOT SPECIFIED' THEN 'press_release' ELSE 'erm' END AS kind FROM orders) o
  JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation h ON o_orderkey % 25 = h.n_nationkey
),
reports AS (
  SELECT (l_orderkey + 1) // 2 AS event_id, 'wire ' || (l_suppkey % 12) AS source_name,
    CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'https://wire' || (l_suppkey % 12) || '.example.org/r/' || l_partkey END AS source_url,
    l_shipdate AS observed_at, CAST(l_linenumber AS BIGINT) AS line FROM lineitem
),
canon AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -event_id - 1 ELSE min(id) END AS canonical_id FROM ledger GROUP BY event_id),
archived AS (
  SELECT md5(trim(source_url)) AS url_hash, CASE WHEN id % 3 = 1 THEN 'archived' ELSE 'pending' END AS status, id % 5 AS attempts
  FROM (SELECT source_url, min(id) AS id FROM ledger WHERE source_url <> '' GROUP BY source_url) WHERE id % 3 <> 0
),
runs AS (
  SELECT event_id AS id, event_type AS source, CASE WHEN event_id % 10 = 0 THEN 'degraded' WHEN event_id % 10 < 3 THEN 'running' ELSE 'ok' END AS status,
    CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE floor(value) END AS BIGINT) AS entries, ts AS attempted_at, user_id AS worker FROM events
)
"""
