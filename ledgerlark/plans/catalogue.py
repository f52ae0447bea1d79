"""The registered queries over the event ledger, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import employers, text
from ..functions.stats import wilson
from ..operators import aggregates, dedup, evidence, mutations, paging, quality, series
from ..operators.filters import FilterSpec, apply_filters, tier
from ..sources import ledger as tables
from ..sources import store
from ..sources.ledger import AS_OF, LEDGER_SQL, read
from .planted import PLANTED_SQL, planted

ONCE = "superset_of = 0"
TIER = "(CASE WHEN source_type IN ('8K', 'warn', 'federal_rif', 'filing') AND verification_level <> 'bronze' THEN 'verified' ELSE 'reported' END)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines name one type."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: wide(f(spark, sf_dir))
        if sql:
            ORACLES[name] = "WITH " + LEDGER_SQL.strip() + sql if sql.lstrip().startswith(",") else "WITH " + LEDGER_SQL.strip() + "\n" + sql
        return f

    return add


def jobs(condition: str = "TRUE") -> str:
    return f"CAST(coalesce(sum(CASE WHEN {condition} THEN job_count END), 0) AS BIGINT)"


def n(condition: str = "TRUE") -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


VERIFIED = f"{TIER} = 'verified'"
MEASURES = f"{jobs()} AS jobs, {jobs('ai_explicit')} AS ai_jobs, {jobs(VERIFIED)} AS verified_jobs, {jobs(VERIFIED + ' AND ai_explicit')} AS verified_ai_jobs"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ledger(spark, sf_dir)


# Filters ---------------------------------------------------------------------------------------------------------------------

#: Name, parameters, and the condition in SQL.
FILTERS = {
    "filter_dates_notice": (dict(date_basis="notice", date_from="1996-02-01", date_to="1997-03-31"), "coalesce(announcement_date, layoff_date) BETWEEN DATE '1996-02-01' AND DATE '1997-03-31'"),
    "filter_calendar_parts": (dict(years=(1996, 1998, 3000), quarters=(1, 3), months=(1, 2, 8)), "year(layoff_date) IN (1996, 1998) AND quarter(layoff_date) IN (1, 3) AND month(layoff_date) IN (1, 2, 8)"),
    "filter_industry_state": (dict(industry=("building", "MACHINERY"), state=("aa", "BC", "DE")), "lower(industry) IN ('building', 'machinery') AND lower(state) IN ('aa', 'bc', 'de')"),
    "filter_country_strict": (dict(country=("NATION_5", "NATION_3", "Nation_7")), "lower(country) IN ('nation_5', 'nation_3', 'nation_7')"),
    "filter_country_employer": (dict(country=("NATION_5", "NATION_3"), country_basis="employer"), "CASE WHEN employer_country <> '' THEN lower(employer_country) IN ('nation_5', 'nation_3') ELSE lower(country) IN ('nation_5', 'nation_3') END"),
    "filter_country_any": (dict(country=("NATION_5", "NATION_3"), country_basis="any"), "lower(country) IN ('nation_5', 'nation_3') OR lower(employer_country) IN ('nation_5', 'nation_3')"),
    "filter_tags_roles": (dict(reasons=("closure", "bankruptcy"), roles=("engineering", "unknown")), "list_has_any(reason_tags, ['closure', 'bankruptcy']) AND list_has_any(role_categories, ['engineering'])"),
    "filter_sources_tier": (dict(sources=("gold", "news"), tier=("verified",)), f"(lower(verification_level) IN ('gold', 'news') OR lower(source_type) IN ('gold', 'news')) AND {TIER} = 'verified'"),
    "filter_ai_tiers": (dict(ai_broad=True), "ai_explicit OR ai_causation = 'ai_linked'"),
    "filter_ai_primary": (dict(ai=True, ai_primary=True), "ai_explicit AND ai_causation = 'primary_cause'"),
    "filter_incomplete": (dict(context_missing=True, roles_missing=True), "len(reason_tags) = 0 AND len(role_categories) = 0 AND source_type NOT IN ('warn', 'erm') AND excerpt <> ''"),
    "filter_no_industry": (dict(industry_missing=True), "industry = ''"),
    "filter_company_key": (dict(company_key=("customer 000000007", "customer 000000011", "none")), "company_key IN ('customer 000000007', 'customer 000000011', 'none')"),
    "filter_company_text": (dict(company="000000012"), "contains(lower(company), '000000012') AND regexp_matches(lower(company), '\\b000000012\\b')"),
    "filter_stage_review": (dict(stage="announced", review_status="pending"), "announced AND review_status = 'pending'"),
    "filter_free_text": (dict(q="jobs at customer"), "(contains(lower(company), 'jobs at customer') OR contains(lower(excerpt), 'jobs at customer')) AND (regexp_matches(lower(company), '\\bjobs at customer\\b') OR regexp_matches(lower(excerpt), '\\bjobs at customer\\b'))"),
    "filter_identity_size": (dict(exclude_supersets=True, min_jobs=2000, exclude_id=8), "superset_of = 0 AND job_count >= 2000 AND id <> 8"),
}
for _name, (_spec, _sql) in FILTERS.items():
    query(_name, f"SELECT id, company, job_count, layoff_date FROM ledger WHERE {_sql}")(
        lambda spark, sf_dir, spec=FilterSpec.of(**_spec): apply_filters(facts(spark, sf_dir), spec).select("id", "company", "job_count", "layoff_date")
    )


@query("sourced_semi", """SELECT l.id, l.event_id, l.job_count FROM ledger l
  WHERE EXISTS (SELECT 1 FROM canon c WHERE c.event_id = l.event_id AND c.canonical_id = l.id)
    AND EXISTS (SELECT 1 FROM reports r WHERE r.event_id = l.event_id AND r.source_url <> '')""")
def _(spark, sf_dir):
    out = apply_filters(facts(spark, sf_dir), FilterSpec.of(sourced=True), tables.events(spark, sf_dir), tables.reports(spark, sf_dir))
    return out.select("id", "event_id", "job_count")


# Totals, rankings, facets ------------------------------------------------------------------------------------------------------

def _distinct(c: str, when: str = ONCE) -> str:
    return f"count(DISTINCT CASE WHEN {when} AND {c} <> '' THEN {c} END)"


@query("agg_totals", f"""SELECT {n(ONCE)} AS entries, {jobs(ONCE)} AS jobs, {n(ONCE + ' AND ai_explicit')} AS ai_entries, {jobs(ONCE + ' AND ai_explicit')} AS ai_jobs,
  {jobs(ONCE + " AND ai_causation = 'primary_cause'")} AS ai_primary_jobs, {jobs(ONCE + " AND (ai_explicit OR ai_causation = 'ai_linked')")} AS ai_broad_jobs,
  {n(ONCE + ' AND announced')} AS announced_entries, {jobs(ONCE + ' AND announced')} AS announced_jobs, {jobs(ONCE + ' AND NOT announced')} AS confirmed_jobs,
  {jobs(ONCE + ' AND ' + VERIFIED)} AS verified_jobs, {jobs(ONCE + ' AND ai_explicit AND ' + VERIFIED)} AS verified_ai_jobs,
  {_distinct('company_key')} AS companies, {_distinct('country')} AS countries, {_distinct('industry')} AS industries, {_distinct('state')} AS states,
  {_distinct('company_key', ONCE + ' AND ai_explicit')} AS ai_companies, min(CASE WHEN {ONCE} AND year(layoff_date) >= 1990 THEN layoff_date END) AS first_date,
  max(CASE WHEN {ONCE} THEN layoff_date END) AS last_date, {n('superset_of <> 0')} AS excluded_entries, {jobs('superset_of <> 0')} AS excluded_jobs FROM ledger""")
def _(spark, sf_dir):
    return aggregates.totals(facts(spark, sf_dir))


@query("agg_concentration", """SELECT id, company, job_count, CAST(s AS BIGINT) AS all_jobs, round(100 * job_count / s, 4) AS share_pct
  FROM (SELECT id, company, job_count, sum(job_count) OVER () AS s, row_number() OVER (ORDER BY job_count DESC, id) AS k FROM ledger WHERE superset_of = 0) WHERE k = 1""")
def _(spark, sf_dir):
    return aggregates.concentration(facts(spark, sf_dir))


for _column in ("country", "industry", "state", "source_type", "employer_country", "tier"):
    _value = TIER if _column == "tier" else _column
    query(f"top_{_column}", f"SELECT {_value} AS label, {MEASURES} FROM ledger WHERE {ONCE} AND announced AND {_value} <> '' GROUP BY 1 ORDER BY jobs DESC, label LIMIT 60")(
        lambda spark, sf_dir, c=_column: aggregates.top(facts(spark, sf_dir), FilterSpec.of(stage="announced"), c)
    )
query("top_industry_except", f"SELECT industry AS label, {MEASURES} FROM ledger WHERE {ONCE} AND year(layoff_date) = 1997 AND industry <> '' GROUP BY 1")(
    lambda spark, sf_dir: aggregates.top(facts(spark, sf_dir), FilterSpec.of(industry="BUILDING", years=1997), "industry")
)
query("facet_counts_sets", f"""SELECT facet, label, count(*) AS entries FROM (SELECT 'country' AS facet, country AS label FROM ledger WHERE {ONCE} UNION ALL
  SELECT 'state', state FROM ledger WHERE {ONCE} UNION ALL SELECT 'industry', industry FROM ledger WHERE {ONCE}) WHERE label <> '' GROUP BY 1, 2""")(
    lambda spark, sf_dir: aggregates.facet_counts(facts(spark, sf_dir))
)
for _name, _column in (("reasons_by_tag", "reason_tags"), ("roles_by_tag", "role_categories")):
    query(_name, f"SELECT tag, count(*) AS entries, {MEASURES} FROM (SELECT *, unnest({_column}) AS tag FROM ledger WHERE {ONCE}) WHERE tag <> 'unknown' GROUP BY tag")(
        lambda spark, sf_dir, c=_column: aggregates.by_tag(facts(spark, sf_dir), c)
    )

_BLOCKS = {"total": "'all'", "country": "country", "employer_country": "employer_country", "industry": "industry", "state": "state", "source_type": "source_type", "tier": TIER, "month": "strftime(layoff_date, '%Y-%m')", "reason": "unnest(reason_tags)", "role": "unnest(role_categories)"}
query("endpoint_blocks", ", b AS (" + " UNION ALL ".join(f"SELECT '{block}' AS block, {label} AS label, job_count, ai_explicit, source_type, verification_level FROM ledger WHERE {ONCE}" for block, label in _BLOCKS.items())
      + f") SELECT block, label, count(*) AS entries, {MEASURES} FROM b WHERE label <> '' AND NOT (block = 'role' AND label = 'unknown') GROUP BY 1, 2")(lambda spark, sf_dir: aggregates.endpoint(facts(spark, sf_dir)))

#: Five filters at once; blocks that have one of them leave their own aside.
_SLICED = FilterSpec.of(country=("NATION_5", "NATION_3", "NATION_17"), industry=("BUILDING", "machinery"), sources=("gold", "news", "warn"), reasons=("closure", "restructuring"), years=(1995, 1996, 1997))
_TESTS = {"country": "lower(country) IN ('nation_5', 'nation_3', 'nation_17')", "industry": "lower(industry) IN ('building', 'machinery')", "sources": "(lower(verification_level) IN ('gold', 'news', 'warn') OR lower(source_type) IN ('gold', 'news', 'warn'))",
          "reasons": "list_has_any(reason_tags, ['closure', 'restructuring'])", "years": "layoff_date IS NOT NULL AND year(layoff_date) IN (1995, 1996, 1997)"}
_SLICED_SQL = ", b AS (" + " UNION ALL ".join(
    f"SELECT '{block}' AS block, {label} AS label, job_count, ai_explicit, source_type, verification_level FROM ledger WHERE {ONCE} AND " + " AND ".join(t for name, t in _TESTS.items() if name != aggregates.BLOCKS[block]) for block, label in _BLOCKS.items()
) + f") SELECT block, label, count(*) AS entries, {MEASURES} FROM b WHERE label <> '' AND NOT (block = 'role' AND label = 'unknown') GROUP BY 1, 2"
query("endpoint_sliced", _SLICED_SQL)(lambda spark, sf_dir: aggregates.endpoint(facts(spark, sf_dir), _SLICED))
query("endpoint_stored", _SLICED_SQL)(lambda spark, sf_dir: aggregates.endpoint(store.stored_ledger(spark, sf_dir).where(store.months_of(_SLICED)), _SLICED))
query("stored_window", "SELECT id, company, job_count, layoff_date FROM ledger WHERE layoff_date BETWEEN DATE '1996-02-11' AND DATE '1996-06-20' AND job_count >= 2000")(
    lambda spark, sf_dir: store.pruned(store.stored_ledger(spark, sf_dir), FilterSpec.of(date_from="1996-02-11", date_to="1996-06-20", min_jobs=2000)).select("id", "company", "job_count", "layoff_date"))
query("stored_join", """, s AS (SELECT company_key, min(layoff_date) AS first_day, CAST(sum(job_count) AS BIGINT) AS announced_jobs FROM ledger WHERE announced AND company_key <> '' AND layoff_date IS NOT NULL GROUP BY 1)
SELECT company_key, announced_jobs, CAST(sum(job_count) AS BIGINT) AS executed_jobs, count(*) AS executions FROM s JOIN ledger l USING (company_key) WHERE NOT announced AND datediff('day', first_day, layoff_date) BETWEEN 0 AND 180 GROUP BY 1, 2""")(
    lambda spark, sf_dir: store.executed_after(store.stored_ledger(spark, sf_dir)))

_BASES = {"effective": "layoff_date", "announcement": "announcement_date", "notice": "coalesce(announcement_date, layoff_date)"}
_DONE = f"coalesce(layoff_date <= DATE '{AS_OF}', FALSE)"
for _basis, _day in _BASES.items():
    query(f"series_{_basis}", f"""SELECT strftime({_day}, '%Y-%m') AS month, count(*) AS entries, {MEASURES}, {jobs('announced')} AS announced_jobs, {n(_DONE)} AS entries_to_date,
      {jobs(_DONE)} AS jobs_to_date, {jobs(_DONE + ' AND ai_explicit')} AS ai_jobs_to_date, {jobs(_DONE + ' AND announced')} AS announced_jobs_to_date
      FROM ledger WHERE {ONCE} AND {_day} IS NOT NULL GROUP BY 1""")(
        lambda spark, sf_dir, b=_basis: aggregates.series(facts(spark, sf_dir), b, AS_OF)
    )
query("repeat_companies", """SELECT company_key, count(*) AS n, CAST(sum(job_count) AS BIGINT) AS jobs, arg_max(company, (job_count, id)) AS company, max(layoff_date) AS last_date
  FROM ledger WHERE company_key <> '' GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, jobs DESC, company_key LIMIT 24""")(lambda spark, sf_dir: aggregates.repeat_companies(facts(spark, sf_dir)))
query("leaders", """SELECT id, company, job_count, layoff_date, country, (SELECT count(*) FROM reports r WHERE r.event_id = l.event_id) AS reports
  FROM ledger l ORDER BY job_count DESC, id DESC LIMIT 24""")(lambda spark, sf_dir: aggregates.leaders(facts(spark, sf_dir), tables.reports(spark, sf_dir)))
for _view, _period, _where in (("country", "ytd", "layoff_date BETWEEN DATE '1997-01-01' AND DATE '1997-08-06'"), ("state", "quarter", "layoff_date BETWEEN DATE '1997-07-01' AND DATE '1997-08-06'"),
                               ("industry", "all", "TRUE"), ("employer_country", "month", "layoff_date BETWEEN DATE '1997-08-01' AND DATE '1997-08-06'"), ("country", "week", "layoff_date BETWEEN DATE '1997-08-04' AND DATE '1997-08-06'")):
    query(f"by_location_{_view}_{_period}", f"""SELECT {_view} AS place, count(*) AS entries, CAST(sum(job_count) AS BIGINT) AS jobs, {n('ai_explicit')} AS ai_entries, {jobs('ai_explicit')} AS ai_jobs FROM ledger
      WHERE {ONCE} AND NOT announced AND {_where} AND {_view} <> '' GROUP BY 1""")(lambda spark, sf_dir, v=_view, p=_period: aggregates.place_board(facts(spark, sf_dir), v, p, "1997-08-06"))
query("facet_ranges", "SELECT 'layoff_date' AS what, CAST(min(layoff_date) AS VARCHAR) AS low, CAST(max(layoff_date) AS VARCHAR) AS high FROM ledger UNION ALL SELECT 'announcement_date', CAST(min(announcement_date) AS VARCHAR), CAST(max(announcement_date) AS VARCHAR) FROM ledger UNION ALL SELECT 'job_count', CAST(min(job_count) AS VARCHAR), CAST(max(job_count) AS VARCHAR) FROM ledger")(
    lambda spark, sf_dir: aggregates.ranges(facts(spark, sf_dir)))
query("conversion_6m", f""", pairs AS (
  SELECT a.id, coalesce(a.announcement_date, a.layoff_date) AS anchor, a.job_count, coalesce(sum(b.job_count), 0) AS after FROM ledger a
  LEFT JOIN (SELECT company_key, layoff_date, job_count FROM ledger WHERE NOT announced AND company_key <> '') b ON a.company_key = b.company_key AND b.layoff_date > coalesce(a.announcement_date, a.layoff_date)
    AND b.layoff_date <= CAST(coalesce(a.announcement_date, a.layoff_date) + INTERVAL 6 MONTH AS DATE)
  WHERE a.announced AND a.company_key <> '' AND coalesce(a.announcement_date, a.layoff_date) IS NOT NULL GROUP BY 1, 2, 3)
SELECT strftime(anchor, '%Y-%m') AS month, count(*) AS announcements, CAST(sum(job_count) AS BIGINT) AS announced_jobs, CAST(sum(least(job_count, after)) AS BIGINT) AS matched_jobs,
  CASE WHEN sum(job_count) > 0 THEN round(100 * sum(least(job_count, after)) / sum(job_count), 1) END AS pct,
  CASE WHEN date_trunc('month', any_value(anchor)) + INTERVAL 7 MONTH <= DATE '{AS_OF}' THEN 'complete' WHEN date_trunc('month', any_value(anchor)) <= DATE '{AS_OF}' THEN 'maturing' ELSE 'pending' END AS status
FROM pairs GROUP BY 1""")(lambda spark, sf_dir: aggregates.conversion(facts(spark, sf_dir), AS_OF))
query("reconciliation_lag", f"""SELECT * FROM (SELECT company_key, arg_max(company, (job_count, id)) AS company, {jobs("source_type IN ('news', 'sec')")} AS announced_jobs, {jobs("source_type = 'warn'")} AS executed_jobs,
  min(CASE WHEN source_type IN ('news', 'sec') THEN coalesce(announcement_date, layoff_date) END) AS first_announced, min(CASE WHEN source_type = 'warn' THEN layoff_date END) AS first_executed,
  CAST(round(100 * least(executed_jobs, announced_jobs) / announced_jobs) AS BIGINT) AS coverage_pct, datediff('day', first_announced, first_executed) AS lag_days
  FROM ledger WHERE year(layoff_date) = 1997 AND company_key <> '' GROUP BY 1) WHERE announced_jobs > 0 AND executed_jobs > 0 ORDER BY announced_jobs DESC, company_key LIMIT 60""")(
    lambda spark, sf_dir: aggregates.reconciliation(facts(spark, sf_dir), 1997)
)
query("notice_gap_rollup", f"""SELECT CASE WHEN grouping(state) = 1 THEN 'ALL' ELSE state END AS state, count(CASE WHEN g > 0 THEN 1 END) AS notices, quantile_cont(CASE WHEN g > 0 THEN g END, 0.5) AS median_days,
  round(avg(CASE WHEN g > 0 THEN CAST(g < 60 AS INTEGER) END), 6) AS short_share, count(CASE WHEN g IS NULL THEN 1 END) AS undated, {n('g < 0')} AS reversed, {n('g = 0')} AS same_day
  FROM (SELECT *, datediff('day', announcement_date, layoff_date) AS g FROM ledger WHERE source_type = 'warn' AND {ONCE}) GROUP BY ROLLUP (state)""")(lambda spark, sf_dir: aggregates.notice_gaps(facts(spark, sf_dir)))
query("stats_periods", f"""SELECT period, count(*) AS entries, CAST(sum(job_count) AS BIGINT) AS jobs, count(DISTINCT company_key) AS companies FROM (
  SELECT *, unnest(list_filter(['all', CASE WHEN date_trunc('week', layoff_date) = date_trunc('week', DATE '{AS_OF}') THEN 'week' END, CASE WHEN date_trunc('month', layoff_date) = date_trunc('month', DATE '{AS_OF}') THEN 'month' END,
    CASE WHEN date_trunc('quarter', layoff_date) = date_trunc('quarter', DATE '{AS_OF}') THEN 'quarter' END, CASE WHEN date_trunc('year', layoff_date) = date_trunc('year', DATE '{AS_OF}') THEN 'year' END], lambda x: x IS NOT NULL)) AS period
  FROM ledger WHERE {ONCE}) GROUP BY 1""")(lambda spark, sf_dir: aggregates.period_stats(facts(spark, sf_dir), AS_OF))
query("employer_ranking", f"""SELECT CASE WHEN ai_explicit THEN 'named' ELSE 'mentioned' END AS kind, company_key, CAST(sum(job_count) AS BIGINT) AS jobs, arg_max(company, (job_count, id)) AS company, arg_max(country, (job_count, id)) AS country,
  arg_max(source_url, (job_count, id)) FILTER (source_url <> '') AS source_url, arg_max(excerpt, (job_count, id)) FILTER (id % 3 <> 0) AS excerpt, row_number() OVER (PARTITION BY CASE WHEN ai_explicit THEN 'named' ELSE 'mentioned' END ORDER BY sum(job_count) DESC, company_key) AS rank
  FROM ledger WHERE {ONCE} AND ai_causation <> 'explicitly_denied' AND (ai_explicit OR ai_causation = 'ai_linked') GROUP BY 1, 2 QUALIFY rank <= 20""")(
    lambda spark, sf_dir: aggregates.employer_ranking(facts(spark, sf_dir).withColumn("excerpt", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("excerpt")))))
query("company_page", """, m AS (SELECT company_key, country, state, industry FROM ledger WHERE company_key <> ''),
c AS (SELECT company_key, country FROM (SELECT company_key, country, row_number() OVER (PARTITION BY company_key ORDER BY count(*) DESC, country) AS k FROM m WHERE country <> '' GROUP BY 1, 2) WHERE k = 1),
s AS (SELECT company_key, state FROM (SELECT company_key, state, row_number() OVER (PARTITION BY company_key ORDER BY count(*) DESC, state) AS k FROM m WHERE state <> '' GROUP BY 1, 2) WHERE k = 1),
i AS (SELECT company_key, industry FROM (SELECT company_key, industry, row_number() OVER (PARTITION BY company_key ORDER BY count(*) DESC, industry) AS k FROM m WHERE industry <> '' GROUP BY 1, 2) WHERE k = 1)
SELECT l.company_key, count(*) AS entries, CAST(sum(job_count) AS BIGINT) AS jobs, min(layoff_date) AS first_date, max(layoff_date) AS last_date, any_value(c.country) AS main_country, any_value(s.state) AS main_state, any_value(i.industry) AS main_industry
FROM ledger l LEFT JOIN c USING (company_key) LEFT JOIN s USING (company_key) LEFT JOIN i USING (company_key) WHERE l.company_key <> '' GROUP BY 1""")(lambda spark, sf_dir: aggregates.company_page(facts(spark, sf_dir)))
query("timeline_years", f"""SELECT year(layoff_date) AS year, CAST(sum(job_count) AS BIGINT) AS jobs, {jobs(_DONE)} AS jobs_to_date, year(layoff_date) = 2000 AS partial FROM ledger
  WHERE {ONCE} AND layoff_date IS NOT NULL GROUP BY 1 HAVING year(layoff_date) <= 2000 OR {jobs(_DONE)} > 0""")(lambda spark, sf_dir: aggregates.timeline(facts(spark, sf_dir), AS_OF))
query("index_buckets", """SELECT CASE WHEN f BETWEEN 'A' AND 'Z' THEN f WHEN f BETWEEN '0' AND '9' THEN '0-9' ELSE '#' END AS bucket, count(*) AS companies
  FROM (SELECT DISTINCT company_key, upper(substr(regexp_replace(company_key, '^[^a-z0-9]+', ''), 1, 1)) AS f FROM ledger WHERE company_key <> '') GROUP BY 1""")(lambda spark, sf_dir: aggregates.index_buckets(facts(spark, sf_dir)))
query("canonical_slugs", """, d AS (SELECT company_key, id, CASE WHEN id % 2 = 0 THEN replace(company_key, ' ', '-') WHEN id % 3 = 0 THEN '' ELSE substr(company_key, 16) || '-' || (id % 3) END AS slug FROM ledger)
SELECT company_key, arg_min(slug, (length(slug), id)) AS slug, CASE WHEN arg_min(slug, (length(slug), id)) SIMILAR TO '[a-z].*' THEN upper(arg_min(slug, (length(slug), id))[1]) ELSE '0-9' END AS bucket FROM d WHERE slug <> '' GROUP BY 1""")(
    lambda spark, sf_dir: aggregates.canonical_slugs(facts(spark, sf_dir).select("company_key", "id", F.expr("CASE WHEN id % 2 = 0 THEN replace(company_key, ' ', '-') WHEN id % 3 = 0 THEN '' ELSE concat(substr(company_key, 16), '-', id % 3) END").alias("slug"))))
query("change_log", """SELECT layoff_date AS day, review_status AS action, source_type AS reason, count(*) AS changes, CASE WHEN count(CASE WHEN id % 50 <> 0 THEN 1 END) = count(*) THEN CAST(sum(job_count) AS BIGINT) END AS jobs
  FROM ledger WHERE edited GROUP BY 1, 2, 3""")(lambda spark, sf_dir: aggregates.change_log(
    facts(spark, sf_dir).where("edited").select(F.col("layoff_date").alias("day"), F.col("review_status").alias("action"), F.col("source_type").alias("reason"), F.when(F.col("id") % 50 != 0, F.col("job_count")).alias("jobs"))))
query("facet_values", """SELECT DISTINCT facet, value FROM (SELECT 'industry' AS facet, industry AS value FROM ledger UNION ALL SELECT 'country', country FROM ledger UNION ALL SELECT 'source_type', source_type FROM ledger) WHERE value <> ''""")(
    lambda spark, sf_dir: facts(spark, sf_dir).select(F.explode(F.create_map(*[x for c in ("industry", "country", "source_type") for x in (F.lit(c), F.col(c))])).alias("facet", "value")).where("value <> ''").distinct())
query("basis_compare", f"""SELECT {jobs("country = 'NATION_5'")} AS strict_jobs, {jobs("CASE WHEN employer_country <> '' THEN employer_country = 'NATION_5' ELSE country = 'NATION_5' END")} AS employer_jobs,
  {jobs("country = 'NATION_5' OR employer_country = 'NATION_5'")} AS any_jobs FROM ledger WHERE {ONCE}""")(lambda spark, sf_dir: quality.basis_compare(facts(spark, sf_dir), "NATION_5"))

# Joins ---------------------------------------------------------------------------------------------------------------------------

query("evidence_list", """, page AS (SELECT id, event_id, source_url FROM ledger ORDER BY id DESC LIMIT 200),
firsts AS (SELECT event_id, source_url, min((observed_at, line, source_name)) AS f FROM reports WHERE source_url <> '' AND event_id IN (SELECT event_id FROM page) GROUP BY 1, 2)
SELECT id, p.event_id, coalesce(string_agg(f.source_url, '|' ORDER BY f.f, f.source_url), '') AS links, count(f.source_url) AS n_links
FROM page p LEFT JOIN firsts f ON p.event_id = f.event_id AND f.source_url <> p.source_url GROUP BY 1, 2""")(
    lambda spark, sf_dir: evidence.evidence_lists(facts(spark, sf_dir).orderBy(F.desc("id")).limit(200), tables.reports(spark, sf_dir)))
query("archive_left", """SELECT id, md5(trim(source_url)) AS url_hash, coalesce(status, 'queued') AS status, coalesce(attempts, 0) AS attempts
  FROM ledger LEFT JOIN archived ON md5(trim(source_url)) = url_hash WHERE source_url <> ''""")(lambda spark, sf_dir: evidence.with_archive(facts(spark, sf_dir), tables.archive(spark, sf_dir)))
query("orphan_anti", "SELECT event_id FROM canon WHERE event_id NOT IN (SELECT event_id FROM reports WHERE source_url <> '')")(
    lambda spark, sf_dir: evidence.unlinked_events(tables.events(spark, sf_dir), tables.reports(spark, sf_dir)))
query("archive_queue", """SELECT source_url, uses, attempts FROM (SELECT source_url, count(*) AS uses FROM ledger WHERE source_url <> '' GROUP BY 1) LEFT JOIN archived ON md5(trim(source_url)) = url_hash
  WHERE status IS NULL OR status <> 'archived' ORDER BY attempts NULLS FIRST, source_url LIMIT 100""")(lambda spark, sf_dir: evidence.archive_queue(facts(spark, sf_dir), tables.archive(spark, sf_dir)))
query("canonical_repair", """SELECT event_id, min(id) AS canonical_id FROM ledger WHERE event_id IN (SELECT event_id FROM canon WHERE canonical_id NOT IN (SELECT id FROM ledger)) GROUP BY 1""")(
    lambda spark, sf_dir: evidence.repaired_canonicals(tables.events(spark, sf_dir), facts(spark, sf_dir)))
query("directory_supported", """SELECT company_key, count(DISTINCT l.event_id) AS events FROM ledger l JOIN canon c ON l.event_id = c.event_id AND l.id = c.canonical_id GROUP BY 1 HAVING count(DISTINCT l.event_id) >= 2""")(
    lambda spark, sf_dir: evidence.supported_directory(facts(spark, sf_dir), tables.events(spark, sf_dir)))
query("lifecycle_pairs", PLANTED_SQL + """ SELECT a.id AS announced_id, b.id AS executed_id, datediff('day', a.layoff_date, b.layoff_date) AS days FROM planted a JOIN planted b ON a.company_key = b.company_key AND a.job_count = b.job_count
  AND a.country = b.country WHERE a.announced AND NOT b.announced AND b.layoff_date - a.layoff_date BETWEEN 0 AND 365 AND (a.state = '' OR b.state = '' OR a.state = b.state) AND a.event_id <> b.event_id
  AND (a.source_url <> b.source_url OR b.source_url = '')""")(lambda spark, sf_dir: evidence.lifecycle_pairs(planted(spark, sf_dir)))
query("seen_urls_anti", """SELECT page_id, url AS source_url FROM pages WHERE url <> '' AND url NOT IN (SELECT source_url FROM ledger UNION SELECT source_url FROM reports)""")(
    lambda spark, sf_dir: evidence.unseen(read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url")), facts(spark, sf_dir), tables.reports(spark, sf_dir)).select("page_id", "source_url"))
query("rebadge_asof", PLANTED_SQL + """, f AS (SELECT id, company_key, job_count, layoff_date FROM planted WHERE company_key <> '' AND layoff_date IS NOT NULL AND source_type <> 'warn')
SELECT a.id, arg_max(b.id, (b.layoff_date, b.id)) AS earlier_id, datediff('day', max(b.layoff_date), a.layoff_date) AS days FROM f a JOIN f b ON a.company_key = b.company_key AND a.job_count = b.job_count
  AND b.layoff_date < a.layoff_date - 180 GROUP BY a.id, a.layoff_date""")(lambda spark, sf_dir: evidence.earlier_same_count(planted(spark, sf_dir)))
query("fuzzy_duplicates", """SELECT a.id AS new_id, arg_min(b.id, (abs(datediff('day', a.layoff_date, b.layoff_date)), b.id)) AS matched_id, count(*) AS matches FROM ledger a JOIN ledger b ON a.company_key = b.company_key AND a.id <> b.id
  AND abs(datediff('day', a.layoff_date, b.layoff_date)) <= 30 AND a.job_count < 3 * b.job_count WHERE a.source_type = 'news' GROUP BY 1""")(
    lambda spark, sf_dir: evidence.fuzzy_matches(facts(spark, sf_dir).where("source_type = 'news'"), facts(spark, sf_dir)))
@query("unique_name_match", """, l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'Shared ' || (c_custkey % 40) ELSE c_name END AS name, c_nationkey AS country FROM customer),
r AS (SELECT c_custkey + 1000000 AS id, c_name AS name, c_nationkey AS country FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey + 2000000, c_name, c_nationkey FROM customer WHERE c_custkey % 7 = 0),
a AS (SELECT name, country, min(id) AS left_id FROM l GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), b AS (SELECT name, country, min(id) AS right_id FROM r GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT name, CAST(country AS BIGINT) AS country, CAST(left_id AS BIGINT) AS left_id, CAST(right_id AS BIGINT) AS right_id FROM a JOIN b USING (name, country)""")
def _(spark, sf_dir):
    """Names of which some are shared on the left and some appear twice on the right."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"))
    left = rows.withColumn("name", F.when(F.col("id") % 10 == 0, F.concat(F.lit("Shared "), F.col("id") % 40)).otherwise(F.col("name")))
    right = rows.where("id % 3 <> 0").withColumn("id", F.col("id") + 1000000).unionByName(rows.where("id % 7 = 0").withColumn("id", F.col("id") + 2000000))
    return evidence.unique_name_matches(left, right)


@query("token_prefix_match", """, a AS (SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 5 = 0 THEN 'customer 0000' ELSE lower(replace(c_name, '#', ' ')) END AS k, DATE '1997-06-01' AS d FROM customer)
SELECT ref_id, id, datediff('day', d, layoff_date) AS days, job_count FROM a JOIN ledger ON company_key = k OR starts_with(company_key, k || ' ') WHERE datediff('day', d, layoff_date) BETWEEN -90 AND 270""")
def _(spark, sf_dir):
    alias = F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'customer 0000' ELSE lower(replace(c_name, '#', ' ')) END")
    return evidence.token_prefix_matches(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_id"), alias.alias("alias_key"), F.lit("1997-06-01").cast("date").alias("ref_day")), facts(spark, sf_dir))


query("presence", """SELECT company_key, count(id) AS entries, count(id) > 0 AS present FROM (SELECT lower(regexp_replace(c_name, '[^A-Za-z0-9]', ' ', 'g')) AS company_key FROM customer) LEFT JOIN ledger USING (company_key) GROUP BY 1""")(
    lambda spark, sf_dir: evidence.seen_presence(read(spark, sf_dir, "customer").select(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", " ")).alias("company_key")), facts(spark, sf_dir)))

query("aligned_presence", """, n AS (SELECT c_custkey AS name_id, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 40 = 0 THEN 'customer' ELSE 'other firm ' || c_custkey END WHEN 1 THEN lower(replace(c_name, '#', ' ')) || ' works' WHEN 2 THEN 'custom' ELSE lower(replace(c_name, '#', ' ')) END AS name_key FROM customer),
k AS (SELECT DISTINCT company_key FROM ledger), m AS (SELECT name_id, count(*) AS employers FROM n JOIN k ON company_key = name_key OR starts_with(company_key, name_key || ' ') OR starts_with(name_key, company_key || ' ') GROUP BY 1)
SELECT name_id, coalesce(employers, 0) AS employers, employers IS NOT NULL AS present FROM n LEFT JOIN m USING (name_id)""")(
    lambda spark, sf_dir: evidence.aligned_presence(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name_id"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 40 = 0 THEN 'customer' ELSE concat('other firm ', c_custkey) END WHEN 1 THEN concat(lower(replace(c_name, '#', ' ')), ' works') WHEN 2 THEN 'custom' ELSE lower(replace(c_name, '#', ' ')) END").alias("name_key")), facts(spark, sf_dir)))

# Deduplication ---------------------------------------------------------------------------------------------------------------------

_CANDIDATES = ", c AS (SELECT * FROM ledger WHERE company_key <> '' AND job_count > 0 AND NOT edited AND layoff_date IS NOT NULL)"
query("dedup_window", _CANDIDATES + """, near AS (SELECT a.id AS news_id, a.job_count AS total, b.id AS notice_id, b.job_count FROM c a JOIN c b ON a.company_key = b.company_key AND abs(datediff('day', a.layoff_date, b.layoff_date)) <= 45
  WHERE a.source_type IN ('news', 'erm', '8K', 'press_release') AND a.job_count >= 200 AND b.source_type = 'warn'),
s AS (SELECT news_id, total, sum(job_count) AS s, arg_max(notice_id, (job_count, -notice_id)) AS largest FROM near GROUP BY 1, 2)
SELECT notice_id AS member, min(n.news_id) AS "primary" FROM near n JOIN s ON n.news_id = s.news_id AND s.total >= s.s GROUP BY 1
UNION ALL SELECT news_id, largest FROM s WHERE total < s AND total >= 0.5 * s""")(lambda spark, sf_dir: dedup.window_marks(facts(spark, sf_dir)))
query("dedup_same_count", PLANTED_SQL + """, c AS (SELECT * FROM planted WHERE company_key <> '' AND job_count > 0 AND NOT edited AND layoff_date IS NOT NULL),
k AS (SELECT id, layoff_date, first_value(id) OVER w AS p, first_value(layoff_date) OVER w AS d FROM c WHERE source_type IN ('news', 'erm', '8K', 'press_release')
  WINDOW w AS (PARTITION BY company_key, job_count ORDER BY ai_explicit DESC, layoff_date, id))
SELECT id AS member, p AS "primary" FROM k WHERE id <> p AND abs(datediff('day', layoff_date, d)) <= 150""")(lambda spark, sf_dir: dedup.same_count_marks(planted(spark, sf_dir)))
query("dedup_revisions", PLANTED_SQL + """, c AS (SELECT * FROM planted WHERE company_key <> '' AND job_count > 0 AND NOT edited AND layoff_date IS NOT NULL),
k AS (SELECT id, layoff_date, first_value(id) OVER w AS p, first_value(layoff_date) OVER w AS d FROM c WHERE source_type = 'warn' AND job_count >= 100 WINDOW w AS (PARTITION BY company_key, state, job_count ORDER BY layoff_date, id))
SELECT id AS member, p AS "primary" FROM k WHERE id <> p AND datediff('day', d, layoff_date) <= 90""")(
    # Revised notices keep their employer's name and carry a mark; the stored key then differs, the revision key must not.
    lambda spark, sf_dir: dedup.revision_marks(planted(spark, sf_dir).withColumn("company", F.expr("CASE id % 4 WHEN 0 THEN concat(company, ' - Revised') WHEN 1 THEN concat(company, ' (Updated)') WHEN 2 THEN concat('Amended: ', company) ELSE company END"))))
query("gap_clusters", """, g AS (SELECT id, company_key, layoff_date, verification_level, job_count, ai_explicit, excerpt, datediff('day', lag(layoff_date) OVER (PARTITION BY company_key ORDER BY layoff_date, id), layoff_date) AS gap FROM ledger WHERE company_key <> '' AND layoff_date IS NOT NULL AND source_type <> 'warn'),
k AS (SELECT *, CAST(sum(CASE WHEN gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY company_key ORDER BY layoff_date, id) AS BIGINT) AS cluster, CASE verification_level WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 WHEN 'bronze' THEN 1 ELSE 0 END AS r FROM g),
q AS (SELECT company_key, cluster, arg_min(id, (-r, -job_count, id)) AS keeper_id, arg_min(excerpt, (-r, -job_count, id)) FILTER (ai_explicit) AS quote FROM k GROUP BY 1, 2)
SELECT id, company_key, cluster, id = keeper_id AS keeper, CASE WHEN id = keeper_id AND NOT ai_explicit THEN quote END AS inherited_quote FROM k JOIN q USING (company_key, cluster)""")(lambda spark, sf_dir: dedup.gap_clusters(facts(spark, sf_dir)))
query("declared_memberships", """, m AS (SELECT id AS member, id + 1 AS p FROM ledger WHERE id % 10 = 0), d AS (SELECT id AS member, CASE WHEN id % 20 = 11 THEN -1 ELSE id - 2 END AS p FROM ledger WHERE id % 10 = 1),
v AS (SELECT * FROM d WHERE p IN (SELECT id FROM ledger) AND p NOT IN (SELECT member FROM d)), o AS (SELECT * FROM m WHERE member NOT IN (SELECT member FROM v) AND member NOT IN (SELECT p FROM v))
SELECT CAST(member AS BIGINT) AS member, CAST(p AS BIGINT) AS "primary" FROM v UNION ALL SELECT o.member, coalesce(v.p, o.p) FROM o LEFT JOIN v ON v.member = o.p WHERE o.member <> coalesce(v.p, o.p)""")(
    lambda spark, sf_dir: dedup.declared_marks(facts(spark, sf_dir).where("id % 10 = 0").select(F.col("id").alias("member"), (F.col("id") + 1).alias("primary")),
        facts(spark, sf_dir).where("id % 10 = 1").select(F.col("id").alias("member"), F.expr("CASE WHEN id % 20 = 11 THEN -1 ELSE id - 2 END").alias("primary")), facts(spark, sf_dir)))
query("membership_changes", """SELECT id, superset_of AS was, CASE WHEN id % 4 = 0 THEN id + 1 ELSE 0 END AS now FROM ledger WHERE superset_of <> CASE WHEN id % 4 = 0 THEN id + 1 ELSE 0 END""")(
    lambda spark, sf_dir: dedup.reconcile_report(facts(spark, sf_dir), facts(spark, sf_dir).where("id % 4 = 0").select(F.col("id").alias("member"), (F.col("id") + 1).alias("primary"))))
query("article_duplicates", PLANTED_SQL + """, a AS (SELECT source_url, job_count, event_id FROM planted WHERE source_url <> '' AND superset_of = 0)
SELECT source_url, job_count, count(DISTINCT event_id) AS events, job_count * (count(DISTINCT event_id) - 1) AS excess FROM a GROUP BY 1, 2 HAVING count(DISTINCT event_id) > 1""")(
    lambda spark, sf_dir: dedup.article_duplicates(planted(spark, sf_dir)))
query("duplicate_shapes", """, r AS (SELECT * FROM ledger WHERE layoff_date IS NOT NULL AND superset_of = 0 AND job_count >= 1000)
SELECT a.id AS first_id, b.id AS second_id, a.job_count AS a_job_count, b.job_count FROM r a JOIN r b ON a.id < b.id AND a.event_id <> b.event_id AND least(a.job_count, b.job_count) >= 0.98 * greatest(a.job_count, b.job_count)
  AND abs(datediff('day', a.layoff_date, b.layoff_date)) <= 30 WHERE (a.country = b.country OR a.country = '' OR b.country = '') AND NOT (a.source_type = 'warn' AND b.source_type = 'warn')""")(
    lambda spark, sf_dir: dedup.shape_pairs(facts(spark, sf_dir)))
query("entry_hash", "SELECT id, md5(lower(trim(company)) || coalesce(CAST(layoff_date AS VARCHAR), '') || job_count) AS hash FROM ledger")(
    lambda spark, sf_dir: facts(spark, sf_dir).select("id", dedup.cross_date_hash(F.col("company"), F.col("layoff_date"), F.col("job_count")).alias("hash")))
query("dedup_reconcile")(lambda spark, sf_dir: dedup.reconcile(planted(spark, sf_dir)))
query("greedy_clusters")(lambda spark, sf_dir: dedup.greedy_clusters(planted(spark, sf_dir)))

# Sorting and paging -----------------------------------------------------------------------------------------------------------------

query("default_page", f"""SELECT id, layoff_date, job_count FROM ledger ORDER BY layoff_date IS NULL, layoff_date > DATE '{AS_OF}', layoff_date DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50""")(
    lambda spark, sf_dir: paging.default_page(facts(spark, sf_dir), AS_OF, page=2).select("id", "layoff_date", "job_count"))
query("changed_after", """SELECT id, updated_at FROM ledger WHERE updated_at > TIMESTAMP '1997-03-01' OR (updated_at = TIMESTAMP '1997-03-01' AND id > 500) ORDER BY updated_at, id LIMIT 201""")(
    lambda spark, sf_dir: paging.changed_after(facts(spark, sf_dir), ("1997-03-01 00:00:00", 500)).select("id", "updated_at"))
for _sort, _down in (("job_count", False), ("company", True), ("layoff_date", False)):
    query(f"page_by_{_sort}", f"SELECT id, layoff_date, job_count, company FROM ledger ORDER BY {_sort} IS NULL, {_sort} {'DESC' if _down else 'ASC'}, id DESC LIMIT 25 OFFSET 25")(
        lambda spark, sf_dir, c=_sort, d=_down: paging.default_page(facts(spark, sf_dir), AS_OF, 2, 25, c, d).select("id", "layoff_date", "job_count", "company"))
query("page_total", "SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM ledger WHERE superset_of = 0 AND job_count >= 2000")(
    lambda spark, sf_dir: apply_filters(facts(spark, sf_dir), FilterSpec.of(exclude_supersets=True, min_jobs=2000)).agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / 25)))
query("review_queue", """, r AS (SELECT id, event_id, job_count, concat_ws(',', CASE WHEN job_count >= 3000 THEN 'very_large_event' END, CASE WHEN ai_causation = 'primary_cause' THEN 'ai_primary_claim' END, CASE WHEN id % 5 = 0 THEN 'multi_country_event' END) AS triggers FROM ledger)
SELECT id, job_count, triggers, (SELECT count(*) FROM reports p WHERE p.event_id = r.event_id) AS reports FROM r WHERE triggers <> '' ORDER BY job_count DESC, id DESC LIMIT 100""")(
    lambda spark, sf_dir: paging.review_queue(facts(spark, sf_dir).withColumn("country", F.when(F.col("id") % 5 == 0, "Multiple countries").otherwise(F.col("country"))), tables.reports(spark, sf_dir), jobs=3000))
query("typeahead", """SELECT company, max(layoff_date) AS last_date, count(*) AS entries FROM ledger WHERE contains(lower(company), '00012') GROUP BY 1
  ORDER BY starts_with(lower(company), '00012') DESC, last_date DESC NULLS LAST, company LIMIT 10""")(lambda spark, sf_dir: paging.typeahead(facts(spark, sf_dir), "00012"))

# Mutations ----------------------------------------------------------------------------------------------------------------------------

@query("upsert_snapshot", """, old AS (SELECT * FROM ledger WHERE id % 3 <> 0), fresh AS (SELECT id + 1000000 AS id, dedup_hash, job_count + 1 AS job_count, CASE WHEN id % 2 = 0 THEN '' ELSE 'NEW' END AS industry FROM ledger WHERE id % 5 = 0
  QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY id DESC) = 1)
SELECT coalesce(o.id, f.id) AS id, coalesce(o.dedup_hash, f.dedup_hash) AS dedup_hash, CASE WHEN f.id IS NULL OR coalesce(o.edited, FALSE) THEN o.job_count ELSE f.job_count END AS job_count,
  CASE WHEN f.id IS NULL OR coalesce(o.edited, FALSE) THEN o.industry ELSE coalesce(nullif(f.industry, ''), o.industry, f.industry) END AS industry FROM old o FULL JOIN fresh f ON o.dedup_hash = f.dedup_hash""")
def _(spark, sf_dir):
    old, base = facts(spark, sf_dir).where("id % 3 <> 0"), facts(spark, sf_dir).where("id % 5 = 0")
    fresh = base.withColumns({"industry": F.when(F.col("id") % 2 == 0, "").otherwise("NEW"), "id": F.col("id") + 1000000, "job_count": F.col("job_count") + 1})
    return mutations.upsert(old, fresh).select("id", "dedup_hash", "job_count", "industry")


query("register_new", "SELECT id, dedup_hash FROM ledger WHERE id % 3 <> 0 UNION ALL SELECT id, dedup_hash FROM ledger WHERE id % 3 = 0 AND dedup_hash NOT IN (SELECT dedup_hash FROM ledger WHERE id % 3 <> 0)")(
    lambda spark, sf_dir: mutations.register(facts(spark, sf_dir).where("id % 3 <> 0").select("id", "dedup_hash"), facts(spark, sf_dir).select("id", "dedup_hash"), "dedup_hash"))
_MERGES = ", p AS (SELECT k.id AS keep_id, d.id AS drop_id, k.event_id AS t, d.event_id AS f, d.dedup_hash FROM ledger k JOIN ledger d ON d.id = k.id + 2 WHERE k.id % 8 = 0), moves AS (SELECT f, min(t) AS t FROM p GROUP BY 1)"


def merges(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return mutations.merge_events(rows, tables.reports(spark, sf_dir), rows.where("id % 8 = 0").select(F.col("id").alias("keep_id"), (F.col("id") + 2).alias("drop_id")))


query("merged_reports", _MERGES + " SELECT coalesce(t, event_id) AS event_id, count(*) AS reports FROM reports LEFT JOIN moves ON f = event_id GROUP BY 1")(lambda spark, sf_dir: merges(spark, sf_dir)[1].groupBy("event_id").agg(F.count(F.lit(1)).alias("reports")))
query("merged_entries", _MERGES + " SELECT id, event_id FROM ledger WHERE id NOT IN (SELECT drop_id FROM p)")(lambda spark, sf_dir: merges(spark, sf_dir)[0].select("id", "event_id"))
query("merged_suppressed", _MERGES + " SELECT DISTINCT dedup_hash FROM p")(lambda spark, sf_dir: merges(spark, sf_dir)[2])
query("upsert_suppressed", """, fresh AS (SELECT dedup_hash, min(id) AS id FROM ledger WHERE id % 3 = 0 AND id % 7 <> 0 GROUP BY 1) SELECT dedup_hash FROM ledger WHERE id % 3 = 1 UNION SELECT dedup_hash FROM fresh WHERE dedup_hash NOT IN (SELECT dedup_hash FROM ledger WHERE id % 7 = 0)""")(
    lambda spark, sf_dir: mutations.upsert(facts(spark, sf_dir).where("id % 3 = 1"), facts(spark, sf_dir).where("id % 3 = 0"), facts(spark, sf_dir).where("id % 7 = 0").select("dedup_hash")).select("dedup_hash").distinct())
query("purge_notices", "SELECT id, source_type FROM ledger WHERE NOT (source_type = 'warn' AND NOT edited)")(lambda spark, sf_dir: mutations.purge_notices(facts(spark, sf_dir)).select("id", "source_type"))
query("plausible_dates", "SELECT id, CASE WHEN year(layoff_date) >= 2000 AND layoff_date <= DATE '2001-01-15' THEN layoff_date END AS layoff_date, CASE WHEN year(announcement_date) >= 2000 AND announcement_date <= DATE '2001-01-15' THEN announcement_date END AS announcement_date FROM ledger")(
    lambda spark, sf_dir: mutations.plausible_dates(facts(spark, sf_dir), "1998-01-15").select("id", "layoff_date", "announcement_date"))
query("cleaned_dates", """, d AS (SELECT id, CAST(layoff_date + INTERVAL 18 YEAR AS DATE) AS layoff_date, CAST(announcement_date + INTERVAL 18 YEAR AS DATE) AS announcement_date FROM ledger)
SELECT id, CASE WHEN year(layoff_date) >= 2015 AND layoff_date <= DATE '2016-07-15' THEN layoff_date END AS layoff_date, CASE WHEN year(announcement_date) >= 2015 AND announcement_date <= DATE '2016-07-15' THEN announcement_date END AS announcement_date FROM d""")(
    lambda spark, sf_dir: mutations.cleaned_dates(facts(spark, sf_dir).withColumns({c: F.add_months(c, 216) for c in ("layoff_date", "announcement_date")}), "2015-01-15").select("id", "layoff_date", "announcement_date"))
query("key_drift", "SELECT id, company_key AS was, trim(regexp_replace(company_key, ' +', ' ', 'g')) || ' x' AS now FROM ledger")(
    lambda spark, sf_dir: mutations.key_drift(facts(spark, sf_dir), lambda c: F.concat(employers.company_key(c), F.lit(" x"))))
query("propagate_industry", """, a AS (SELECT company_key, min(industry) AS agreed FROM ledger WHERE industry <> '' AND company_key <> '' GROUP BY 1 HAVING count(DISTINCT industry) = 1)
SELECT id, agreed AS industry FROM ledger JOIN a USING (company_key) WHERE industry = ''""")(lambda spark, sf_dir: mutations.propagate_industry(facts(spark, sf_dir)))
query("state_diff", """SELECT id, CASE WHEN id % 3 <> 0 THEN job_count END AS was, CASE WHEN id % 4 <> 0 THEN job_count END AS now FROM ledger WHERE id % 3 = 0 AND id % 4 <> 0 OR id % 3 <> 0 AND id % 4 = 0""")(
    lambda spark, sf_dir: mutations.state_diff(facts(spark, sf_dir).where("id % 3 <> 0").select("id", F.col("job_count").alias("value")), facts(spark, sf_dir).where("id % 4 <> 0").select("id", F.col("job_count").alias("value"))))
query("newest_slots", """, b AS (SELECT worker AS slot, attempted_at AS updated, status, 1 AS own, id FROM runs WHERE id % 2 = 0 UNION ALL SELECT worker, attempted_at, status, 0, id FROM runs WHERE id % 2 = 1)
SELECT slot, max(updated) AS updated, arg_max(status, (updated, own)) AS status FROM b GROUP BY 1""")(
    lambda spark, sf_dir: mutations.newest_slots(*[tables.source_runs(spark, sf_dir).where(f"id % 2 = {k}").select(F.col("worker").alias("slot"), F.col("attempted_at").alias("updated"), "status") for k in (0, 1)]))
