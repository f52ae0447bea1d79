"""Registered queries of reports, audits, mutations and the interface's rows, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, mutations, reconcile, reports, series
from ..sources import ledger as tables
from ..sources.ledger import AS_OF, read
from .catalogue import ONCE, TIER, facts, jobs, n, query
from .measures import months
from .planted import PLANTED_SQL, pick, picked, planted

HOME = "NATION_5"

# Reports ---------------------------------------------------------------------------------------------------------------------------------

query("integrity_status", f""", r AS (SELECT count(*) AS reports, count(DISTINCT CASE WHEN source_url <> '' THEN event_id END) AS linked_events FROM reports), e AS (SELECT count(*) AS events FROM canon)
SELECT count(*) AS rows, {n('event_id > 0')} AS rows_with_event, {n("industry = ''")} AS missing_industry, {n(f"country = '{HOME}'")} AS home_rows, {n(f"country = '{HOME}' AND state = ''")} AS home_rows_missing_state, any_value(events) AS events,
  any_value(reports) AS reports, any_value(linked_events) AS linked_events, greatest(any_value(events) - any_value(linked_events), 0) AS unlinked_events, greatest(count(*) - {n('event_id > 0')}, 0) AS rows_remaining, count(*) = {n('event_id > 0')} AS complete FROM ledger, r, e""")(
    lambda spark, sf_dir: reports.integrity(facts(spark, sf_dir), tables.events(spark, sf_dir), tables.reports(spark, sf_dir), HOME))
query("link_gaps", "SELECT id, event_id, company, layoff_date FROM ledger WHERE event_id > 0 AND event_id NOT IN (SELECT event_id FROM reports WHERE source_url <> '') ORDER BY id LIMIT 5")(
    lambda spark, sf_dir: reports.link_gaps(facts(spark, sf_dir), tables.reports(spark, sf_dir)))
query("archive_coverage", """, u AS (SELECT DISTINCT source_url FROM ledger WHERE starts_with(source_url, 'http')), o AS (SELECT count(*) AS open_cited, max(attempts) AS most_attempts FROM archived WHERE status IN ('pending', 'unavailable') AND url_hash IN (SELECT md5(trim(source_url)) FROM u)),
b AS (SELECT count(CASE WHEN status = 'archived' THEN 1 END) AS archived, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'unavailable' THEN 1 END) AS unavailable FROM archived)
SELECT (SELECT count(*) FROM u) AS addresses, archived, pending, unavailable, open_cited, most_attempts, greatest((SELECT count(*) FROM u) - archived - pending - unavailable, 0) AS queued FROM b, o""")(
    lambda spark, sf_dir: reports.archive_coverage(facts(spark, sf_dir), tables.archive(spark, sf_dir)))
query("archive_requeued", """, a AS (SELECT *, length(url_hash) > 0 AND attempts % 2 = 0 AS uncited FROM archived), c AS (SELECT DISTINCT md5(trim(source_url)) AS h FROM ledger WHERE starts_with(source_url, 'http') AND id % 4 <> 0)
SELECT url_hash, status, CASE WHEN status = 'pending' AND uncited AND h IS NOT NULL THEN NULL ELSE attempts END AS attempts, CASE WHEN status <> 'pending' THEN uncited WHEN uncited AND h IS NOT NULL THEN FALSE WHEN h IS NULL THEN TRUE ELSE uncited END AS uncited FROM a LEFT JOIN c ON url_hash = h""")(
    lambda spark, sf_dir: reports.requeued(tables.archive(spark, sf_dir).withColumn("uncited", F.col("attempts") % 2 == 0), facts(spark, sf_dir).where("id % 4 <> 0")))
ACTIONS = ["edited", "removed", "merged", "enriched", "viewed", "corrected"]
REASONS = ["Automated backfill", "a reader wrote to us", "audit after a reader's tip", "no reason given", "parser repair", "contact page"]


def changes(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return rows.select(F.to_date("updated_at").alias("day"), picked(ACTIONS).alias("action"), picked(REASONS, "job_count").alias("reason"), F.lit("").alias("detail"), (F.col("id") % 5 - 1).alias("changes"))


query("disclosed_changes", f"""SELECT action, CAST(sum(changes) AS BIGINT) AS changes FROM (SELECT CASE {pick(ACTIONS)} WHEN 'edited' THEN 'corrected' ELSE {pick(ACTIONS)} END AS action, greatest(id % 5 - 1, 0) AS changes, CAST(updated_at AS DATE) AS day FROM ledger)
  WHERE day >= DATE '1998-07-01' - 30 AND action <> 'viewed' GROUP BY 1""")(lambda spark, sf_dir: reports.disclosed_changes(changes(spark, sf_dir), "1998-07-01"))
query("change_provenance", f"SELECT origin, count(*) AS entries FROM (SELECT {pick(['internal', 'external', 'unrecorded', 'unrecorded', 'internal', 'external'], 'job_count')} AS origin FROM ledger) GROUP BY 1")(lambda spark, sf_dir: reports.provenance(changes(spark, sf_dir)))
_NOW, _BEFORE = "layoff_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'", "layoff_date BETWEEN DATE '1997-02-01' AND DATE '1997-02-28'"
query("monthly_figures", f""", v AS (SELECT * FROM ledger WHERE {ONCE} AND NOT announced), t AS (SELECT {jobs(_NOW)} AS verified_jobs, {n(_NOW)} AS entries, {jobs(_NOW + ' AND ai_explicit')} AS ai_verified_jobs, {jobs(_BEFORE)} AS prior_verified_jobs FROM v),
p AS (SELECT 'top_company' AS figure, company AS label, sum(job_count) AS value FROM v WHERE {_NOW} GROUP BY 2 UNION ALL SELECT 'top_state', state, sum(job_count) FROM v WHERE {_NOW} AND state <> '' GROUP BY 2 UNION ALL SELECT 'top_country', country, sum(job_count) FROM v WHERE {_NOW} GROUP BY 2)
SELECT figure, CAST(0 AS BIGINT) AS rank, '' AS label, value FROM (UNPIVOT t ON verified_jobs, entries, ai_verified_jobs, prior_verified_jobs INTO NAME figure VALUE value)
UNION ALL SELECT figure, row_number() OVER (PARTITION BY figure ORDER BY value DESC, label) AS k, label, CAST(value AS BIGINT) FROM p QUALIFY k <= 5""")(lambda spark, sf_dir: reports.monthly_figures(facts(spark, sf_dir), "1997-03"))
query("weekly_briefing", f""", w AS (SELECT CAST(date_trunc('week', layoff_date) AS DATE) AS week, CAST(sum(job_count) AS BIGINT) AS jobs, count(*) AS entries FROM ledger WHERE {ONCE} AND NOT announced AND layoff_date IS NOT NULL GROUP BY 1),
m AS (SELECT *, CASE WHEN count(jobs) OVER x = 8 THEN quantile_cont(jobs, 0.5) OVER x END AS median_before FROM w WINDOW x AS (ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT week, jobs, entries, CAST(median_before AS DOUBLE) AS median_before, DATE '{AS_OF}' - (week + 6) < 14 AS provisional, coalesce(jobs > 3 * median_before, FALSE) AS outlier FROM m""")(lambda spark, sf_dir: reports.weekly_briefing(facts(spark, sf_dir), AS_OF))
query("source_classes", f"""SELECT CASE WHEN source_type = 'warn' AND country = '{HOME}' THEN 'US state WARN notices' WHEN source_type = 'warn' THEN 'government collective-dismissal notices outside the US' WHEN source_type = '8K' THEN 'SEC 8-K filings'
  WHEN source_type = 'news' THEN 'named news reports' WHEN source_type = 'erm' THEN 'the European Restructuring Monitor' ELSE 'other published sources' END AS class, CAST(sum(job_count) AS BIGINT) AS jobs FROM ledger WHERE {ONCE} AND NOT announced GROUP BY 1""")(
    lambda spark, sf_dir: reports.source_classes(facts(spark, sf_dir), HOME))
_REGION = "CASE WHEN {c} IN ('NATION_1', 'NATION_2', 'NATION_3') THEN 'First' WHEN {c} IN ('NATION_4', 'NATION_5') THEN 'Second' WHEN {c} = '' THEN 'Not recorded' ELSE 'Other countries' END"
query("region_totals", f""", p AS (SELECT CASE WHEN id % 4 = 0 THEN '' ELSE country END AS country, employer_country, job_count FROM ledger WHERE {ONCE} AND NOT announced)
SELECT CASE WHEN country <> '' THEN {_REGION.format(c='country')} ELSE {_REGION.format(c='employer_country')} END AS region, CAST(sum(job_count) AS BIGINT) AS jobs, {jobs("country = '' AND employer_country <> ''")} AS jobs_by_home FROM p GROUP BY 1""")(
    lambda spark, sf_dir: reports.region_totals(facts(spark, sf_dir).withColumn("country", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("country"))), {"First": "NATION_1|NATION_2|NATION_3", "Second": "NATION_4|NATION_5"}))


def notices(spark, sf_dir):
    """Notices with a templated excerpt: cities in capitals and in mixed letters, one that is part of the employer's name, and none."""
    rows = facts(spark, sf_dir).where("source_type = 'warn'")
    city = picked(["AUSTIN", "Austin", "El Paso", "Waco"], "id")
    told = F.when(F.col("id") % 7 == 0, F.concat(F.lit("Layoff at Acme (Store in Dallas). "), "job_count", F.lit(" employees affected"))).when(F.col("id") % 7 == 1, "no city here")
    return rows.withColumn("excerpt", told.otherwise(F.concat(F.lit("Layoff at "), "company", F.lit(" in "), city, F.lit(". "), F.format_number("job_count", 0), F.lit(" employees affected."))))


query("notice_ranks", f""", w AS (SELECT *, {pick(["AUSTIN", "Austin", "El Paso", "Waco"])} AS city FROM ledger WHERE source_type = 'warn'),
e AS (SELECT 'employer' AS kind, arg_min(company, id) AS label, count(*) AS notices, CAST(sum(job_count) AS BIGINT) AS jobs FROM w GROUP BY lower(company)),
c AS (SELECT 'city' AS kind, CASE WHEN arg_min(city, id) = 'AUSTIN' THEN 'Austin' ELSE arg_min(city, id) END AS label, count(*) AS notices, CAST(sum(job_count) AS BIGINT) AS jobs FROM w WHERE id % 7 > 1 GROUP BY lower(city))
SELECT * FROM (SELECT * FROM e ORDER BY jobs DESC, notices DESC, label LIMIT 10) UNION ALL SELECT * FROM c""")(lambda spark, sf_dir: reports.ranked_places(notices(spark, sf_dir)))
query("notice_months", "SELECT strftime(layoff_date, '%Y-%m') AS month, count(*) AS notices, CAST(sum(job_count) AS BIGINT) AS jobs FROM ledger WHERE source_type = 'warn' AND layoff_date IS NOT NULL GROUP BY 1")(lambda spark, sf_dir: reports.notice_months(notices(spark, sf_dir)))
for _name, _value in (("country", "country"), ("month", "strftime(layoff_date, '%Y-%m')")):
    query(f"last_changes_{_name}", f"""SELECT {_value} AS value, max(least(DATE '1998-06-30', greatest(CAST(updated_at AS DATE), coalesce(announcement_date, DATE '1970-01-01'), coalesce(layoff_date, DATE '1970-01-01')))) AS last_change
      FROM ledger WHERE {ONCE} AND {_value} <> '' GROUP BY 1""")(lambda spark, sf_dir, c=_name: reports.last_changes(facts(spark, sf_dir), c, "1998-06-30"))
query("mean_of_means", """SELECT month, round(avg(m), 1) AS value, count(*) AS series FROM (SELECT strftime(ts, '%Y-%m') AS month, event_type, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")(
    lambda spark, sf_dir: reports.mean_of_means(read(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("ts").alias("day"), "value")))
query("quarter_sums", "SELECT year(layoff_date) || '-Q' || quarter(layoff_date) AS quarter, CAST(sum(job_count) AS BIGINT) AS value FROM ledger WHERE industry IN ('BUILDING', 'MACHINERY') AND layoff_date IS NOT NULL GROUP BY 1")(
    lambda spark, sf_dir: reports.quarter_sums(facts(spark, sf_dir).where("layoff_date IS NOT NULL").select(F.col("industry").alias("sector"), F.col("layoff_date").alias("day"), F.col("job_count").alias("value")), ("BUILDING", "MACHINERY")))
query("notice_counts", "SELECT strftime(announcement_date, '%Y-%m') AS month, industry, count(*) AS notices FROM ledger WHERE source_type = 'warn' AND industry <> '' AND announcement_date >= DATE '1995-01-01' AND country = 'NATION_5' GROUP BY 1, 2")(
    lambda spark, sf_dir: reports.notice_counts(facts(spark, sf_dir), HOME, "1995-01-01"))
_EARLY = """, p AS (SELECT industry, source_type AS series, source_type <> 'news' AS official, strftime(layoff_date, '%Y-%m') AS month, CAST(sum(job_count) AS BIGINT) AS value FROM ledger WHERE industry <> '' AND layoff_date IS NOT NULL GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY industry, series ORDER BY month DESC) AS k FROM p), g AS (SELECT industry, series, official, max(k) AS points, avg(CASE WHEN k <= 3 THEN value END) AS a, avg(CASE WHEN k BETWEEN 4 AND 15 THEN value END) AS b FROM r GROUP BY 1, 2, 3),
d AS (SELECT industry, series, official, points, CASE WHEN points >= 15 AND b > 0 THEN round(a / b - 1, 6) END AS change FROM g), x AS (SELECT *, CASE WHEN change >= 0.05 THEN 'up' WHEN change <= -0.05 THEN 'down' WHEN change IS NOT NULL THEN 'flat' END AS direction FROM d),
u AS (SELECT industry, count(CASE WHEN official AND direction = 'up' THEN 1 END) AS up, count(CASE WHEN official AND direction = 'down' THEN 1 END) AS down, count(CASE WHEN official THEN direction END) AS judged FROM x GROUP BY 1)
SELECT x.*, CASE WHEN judged < 2 THEN NULL WHEN up >= 2 AND up > down THEN 'heating' WHEN down >= 2 AND down > up THEN 'cooling' ELSE 'stable' END AS status FROM x JOIN u USING (industry)"""
query("early_warning", _EARLY)(lambda spark, sf_dir: reports.early_warning(
    facts(spark, sf_dir).where("industry <> '' AND layoff_date IS NOT NULL").groupBy("industry", F.col("source_type").alias("series"), (F.col("source_type") != "news").alias("official"), F.date_format("layoff_date", "yyyy-MM").alias("month")).agg(F.sum("job_count").alias("value"))))
query("ranked_rules", """, t AS (SELECT source_type AS kind, company AS term, count(*) AS n FROM ledger GROUP BY 1, 2 HAVING count(*) >= CASE source_type WHEN 'news' THEN 4 WHEN 'warn' THEN 2 ELSE 1 END)
SELECT kind, term, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS rank FROM t QUALIFY rank <= 7""")(
    lambda spark, sf_dir: reports.ranked_rules(facts(spark, sf_dir).select(F.col("source_type").alias("kind"), F.col("company").alias("term")), {"news": 4, "warn": 2}, 7))
query("top_areas", """, r AS (SELECT country AS area, industry AS occupation, sum(job_count) AS jobs FROM ledger GROUP BY 1, 2), t AS (SELECT area, sum(jobs) AS total FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
SELECT area, CAST(total AS BIGINT) AS total, occupation, CAST(jobs AS BIGINT) AS jobs, row_number() OVER (PARTITION BY area ORDER BY jobs DESC, occupation) AS rank FROM r JOIN t USING (area) WHERE occupation LIKE '%U%' QUALIFY rank <= 2""")(
    lambda spark, sf_dir: reports.top_areas(facts(spark, sf_dir).groupBy(F.col("country").alias("area"), F.col("industry").alias("occupation")).agg(F.sum("job_count").alias("jobs")), 6, 2, facts(spark, sf_dir).select(F.col("industry").alias("occupation")).distinct().where("occupation LIKE '%U%'")))
query("quarterly_snapshot", f""", q AS (SELECT *, unnest(list_filter([CASE WHEN NOT announced THEN 'verified' END, CASE WHEN announced THEN 'announced' END, CASE WHEN NOT announced AND ai_causation = 'primary_cause' THEN 'ai_primary_verified' END], lambda x: x IS NOT NULL)) AS tier
  FROM ledger WHERE {ONCE} AND layoff_date BETWEEN DATE '1997-04-01' AND DATE '1997-06-30') SELECT tier, count(*) AS entries, CAST(sum(job_count) AS BIGINT) AS jobs, count(DISTINCT company_key) AS companies FROM q GROUP BY 1""")(lambda spark, sf_dir: reports.quarterly_snapshot(facts(spark, sf_dir), "1997-Q2"))
query("release_counts", "SELECT '1.0' AS version, 'rows' AS what, count(*) AS n FROM ledger UNION ALL SELECT '1.0', 'events', count(*) FROM canon UNION ALL SELECT '1.0', 'reports', count(*) FROM reports")(
    lambda spark, sf_dir: reports.release(facts(spark, sf_dir), tables.events(spark, sf_dir), tables.reports(spark, sf_dir), "1.0"))
query("directory_coverage", """, s AS (SELECT company_key, count(DISTINCT l.event_id) AS events FROM ledger l JOIN canon c ON l.event_id = c.event_id AND l.id = c.canonical_id GROUP BY 1),
d AS (SELECT DISTINCT company_key, ['approved', 'noindex', 'pending', 'approved'][length(replace(company_key, '0', '')) % 4 + 1] AS review_status FROM ledger WHERE company_key NOT LIKE '%3')
SELECT count(*) AS employers, count(CASE WHEN events >= 5 THEN 1 END) AS above_floor, count(review_status) AS mapped, count(CASE WHEN review_status = 'approved' THEN 1 END) AS approved, count(CASE WHEN review_status = 'noindex' THEN 1 END) AS noindex,
  count(CASE WHEN review_status = 'pending' THEN 1 END) AS pending, count(*) - count(review_status) AS not_indexed FROM s LEFT JOIN d USING (company_key)""")(
    lambda spark, sf_dir: reports.directory_coverage(evidence.supported_directory(facts(spark, sf_dir), tables.events(spark, sf_dir), 1),
        facts(spark, sf_dir).where("company_key NOT LIKE '%3'").select("company_key").distinct().withColumn("review_status", F.element_at(F.array(*map(F.lit, ("approved", "noindex", "pending", "approved"))), (F.length(F.replace("company_key", F.lit("0"))) % 4 + 1))), 5))
query("exposure", """, o AS (SELECT p_type AS occupation, CAST(sum(p_size) AS BIGINT) AS jobs FROM part GROUP BY 1)
SELECT occupation, CASE WHEN length(occupation) % 2 = 0 THEN 'Title ' || occupation ELSE occupation END AS title, CAST(length(occupation) AS BIGINT) AS score, jobs, CASE WHEN length(occupation) % 5 = 0 THEN CAST(length(occupation) * 2 AS BIGINT) END AS growth FROM o WHERE length(occupation) % 3 > 0""")(
    lambda spark, sf_dir: (lambda o: reports.exposure(o, o.where("length(occupation) % 3 > 0").select("occupation", F.length("occupation").alias("score")), o.where("length(occupation) % 2 = 0").select("occupation", F.concat(F.lit("Title "), "occupation").alias("title")),
        o.where("length(occupation) % 5 = 0").select("occupation", (F.length("occupation") * 2).alias("growth"))))(read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("occupation")).agg(F.sum("p_size").alias("jobs"))))
query("reference_rows", "SELECT id, country, job_count FROM ledger WHERE country IN ('NATION_1', 'NATION_2') AND CAST(confidence AS VARCHAR) IN ('7', '8', '9')")(
    lambda spark, sf_dir: reports.reference_rows(facts(spark, sf_dir).select("id", "country", "job_count", "confidence"), country="NATION_1, NATION_2", confidence="7,8, 9").select("id", "country", "job_count"))
_SURVEY = f""", l AS (SELECT strftime(layoff_date, '%Y-%m') AS month, {jobs('NOT announced')} AS strict, CAST(sum(job_count) AS BIGINT) AS broad FROM ledger WHERE {ONCE} AND layoff_date IS NOT NULL GROUP BY 1),
s AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(floor(o_totalprice / 50) AS BIGINT)) AS BIGINT) AS survey FROM orders GROUP BY 1),
y AS (SELECT month, survey, strict, broad, CAST(sum(survey) OVER w AS BIGINT) AS survey_ytd, CAST(sum(strict) OVER w AS BIGINT) AS strict_ytd, CAST(sum(broad) OVER w AS BIGINT) AS broad_ytd FROM s LEFT JOIN l USING (month) WINDOW w AS (PARTITION BY month[1:4] ORDER BY month ROWS UNBOUNDED PRECEDING))
SELECT *, CASE WHEN survey > 0 THEN round(100 * strict / survey, 1) END AS strict_pct, CASE WHEN survey_ytd > 0 THEN round(100 * broad_ytd / survey_ytd, 1) END AS broad_ytd_pct FROM y"""
query("survey_comparison", _SURVEY)(lambda spark, sf_dir: reports.survey_comparison(facts(spark, sf_dir), read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.floor(F.col("o_totalprice") / 50).cast("long")).alias("jobs"))))
query("claims_overlay", """, m AS (SELECT DISTINCT strftime(layoff_date, '%Y-%m') AS month FROM ledger WHERE layoff_date IS NOT NULL), o AS (SELECT strftime(layoff_date, '%Y-%m') AS month, CAST(sum(job_count) AS BIGINT) AS own FROM ledger WHERE state = 'AB' AND layoff_date IS NOT NULL GROUP BY 1),
u AS (SELECT strftime(layoff_date, '%Y-%m') AS month, CAST(sum(job_count) AS BIGINT) AS national FROM ledger WHERE id % 4 = 0 AND layoff_date IS NOT NULL AND month(layoff_date) <> 5 GROUP BY 1)
SELECT month, coalesce(own, national) AS value, CASE WHEN own IS NOT NULL THEN 'AB' WHEN national IS NOT NULL THEN 'US' END AS series FROM m LEFT JOIN o USING (month) LEFT JOIN u USING (month)""")(
    lambda spark, sf_dir: (lambda d: reports.overlay(d.select("month").distinct(), d.where("state <> ''").groupBy(F.col("state").alias("place"), "month").agg(F.sum("job_count").alias("value")).unionByName(
        d.where("id % 4 = 0 AND month(layoff_date) <> 5").groupBy(F.lit("US").alias("place"), "month").agg(F.sum("job_count").alias("value"))), "AB"))(facts(spark, sf_dir).where("layoff_date IS NOT NULL").withColumn("month", F.date_format("layoff_date", "yyyy-MM"))))

# Series of the chart -----------------------------------------------------------------------------------------------------------------------

query("partial_month", f""", m AS (SELECT strftime(layoff_date, '%Y-%m') AS month, CAST(sum(job_count) AS BIGINT) AS jobs, {jobs("layoff_date <= DATE '1997-03-12'")} AS done FROM ledger WHERE {ONCE} AND layoff_date IS NOT NULL GROUP BY 1),
d AS (SELECT month, jobs AS total, CASE WHEN month < '1997-03' THEN jobs WHEN month = '1997-03' THEN done ELSE 0 END AS jobs FROM m) SELECT month, jobs, total - jobs AS still_to_come, month = '1997-03' AS partial FROM d""")(
    lambda spark, sf_dir: reconcile.replaced_partial_month(facts(spark, sf_dir).where("superset_of = 0 AND layoff_date IS NOT NULL").groupBy(F.date_format("layoff_date", "yyyy-MM").alias("month")).agg(F.sum("job_count").alias("jobs"), F.coalesce(F.sum(F.expr("CASE WHEN layoff_date <= DATE '1997-03-12' THEN job_count END")), F.lit(0)).alias("jobs_to_date")), "1997-03-12"))
query("reranked_tops", f""", t AS (SELECT industry AS label, CAST(sum(job_count) AS BIGINT) AS jobs, CASE WHEN industry <> 'BUILDING' THEN {jobs(TIER + " = 'verified' AND industry <> 'MACHINERY'")} END AS v FROM ledger WHERE {ONCE} AND industry <> '' GROUP BY 1)
SELECT label, coalesce(v, jobs) AS jobs FROM t WHERE coalesce(v, jobs) > 0""")(
    lambda spark, sf_dir: reconcile.reranked(facts(spark, sf_dir).where("superset_of = 0 AND industry <> ''").groupBy(F.col("industry").alias("label")).agg(F.sum("job_count").alias("jobs"), F.coalesce(F.sum(F.expr(f"CASE WHEN {TIER} = 'verified' AND industry <> 'MACHINERY' THEN job_count END")), F.lit(0)).alias("v")).withColumn("verified_jobs", F.when(F.col("label") != "BUILDING", F.col("v")))))
query("log_scale", """, c AS (SELECT country AS label, sum(job_count) AS jobs FROM ledger WHERE superset_of = 0 AND layoff_date IS NOT NULL GROUP BY 1, strftime(layoff_date, '%Y-%m')), t AS (SELECT label, max(jobs) AS top FROM c GROUP BY 1 HAVING max(jobs) > 0)
SELECT coalesce(max(top) / min(top) > 25, FALSE) AS log_scale, count(*) AS series FROM t""")(lambda spark, sf_dir: reconcile.needs_log_scale(series.compare(facts(spark, sf_dir), "country")))
query("daily_slice", """, w AS (SELECT DISTINCT company_key AS key FROM ledger), p AS (SELECT key, row_number() OVER (ORDER BY md5(key)) - 1 AS place, count(*) OVER () AS all_ FROM w)
SELECT key FROM p WHERE ((place - datediff('day', DATE '1970-01-01', DATE '1998-02-03') * 40) % all_ + all_) % all_ < 40""")(lambda spark, sf_dir: reconcile.daily_slice(facts(spark, sf_dir).select(F.col("company_key").alias("key")), "1998-02-03", 40))

# Audits --------------------------------------------------------------------------------------------------------------------------------------

query("dateless_neighbours", """, u AS (SELECT * FROM ledger WHERE layoff_date IS NULL AND job_count >= 1000), p AS (SELECT u.id AS undated_id, b.id, u.country = b.country AS same, least(u.job_count, b.job_count) / greatest(u.job_count, b.job_count) AS r
  FROM u JOIN ledger b ON u.id <> b.id AND b.job_count >= 1000 AND u.country = b.country AND least(u.job_count, b.job_count) >= 0.98 * greatest(u.job_count, b.job_count))
SELECT undated_id, id, row_number() OVER (PARTITION BY undated_id ORDER BY r DESC, id) AS rank FROM p QUALIFY rank <= 5""")(lambda spark, sf_dir: reconcile.dateless_neighbours(facts(spark, sf_dir)))
query("cross_alias_groups", PLANTED_SQL + """, r AS (SELECT * FROM planted WHERE layoff_date IS NOT NULL AND source_type <> 'warn' AND job_count > 0), e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id < b.id AND a.job_count = b.job_count AND abs(datediff('day', a.layoff_date, b.layoff_date)) <= 2
  AND a.event_id <> b.event_id AND a.company_key = b.company_key), v AS (SELECT a AS id FROM e UNION SELECT b FROM e), m AS (SELECT v.id, least(v.id, coalesce((SELECT min(a) FROM e WHERE e.b = v.id), v.id)) AS component FROM v) SELECT * FROM m""")(lambda spark, sf_dir: reconcile.cross_alias_groups(planted(spark, sf_dir)))
query("notice_hash", "SELECT id, md5('warn' || lower(trim(company)) || coalesce(CAST(layoff_date AS VARCHAR), '') || job_count || lower(state)) AS hash FROM ledger")(
    lambda spark, sf_dir: facts(spark, sf_dir).select("id", reconcile.notice_hash(F.col("company"), F.col("layoff_date"), F.col("job_count"), F.col("state")).alias("hash")))
query("agency_hash", "SELECT id, md5('fedrif' || lower(trim(country)) || strftime(layoff_date, '%Y%m')) AS hash FROM ledger")(
    lambda spark, sf_dir: facts(spark, sf_dir).select("id", reconcile.agency_hash(F.concat(F.lit(" "), "country"), F.date_format("layoff_date", "yyyyMM")).alias("hash")))
query("canonical_of_cluster", """SELECT company_key AS cluster, arg_min(id, (CAST(announced AS INTEGER), coalesce(CAST(layoff_date AS VARCHAR), '9999'), -CASE source_type WHEN '8K' THEN 3 WHEN 'warn' THEN 3 WHEN 'press_release' THEN 2 WHEN 'erm' THEN 2 WHEN 'news' THEN 1 ELSE 0 END, id)) AS canonical_id, count(*) AS n FROM ledger GROUP BY 1""")(
    lambda spark, sf_dir: reconcile.canonical_of(facts(spark, sf_dir).withColumn("cluster", F.col("company_key"))))
query("gold_recall", """, g AS (SELECT id AS case_id, id % 3 = 0 AS adjudicated FROM ledger WHERE source_type = 'warn'), m AS (SELECT DISTINCT id AS case_id FROM ledger WHERE id % 10 < 9)
SELECT count(*) AS cases, count(m.case_id) AS found, count(CASE WHEN adjudicated AND m.case_id IS NULL THEN 1 END) AS lost, round(count(m.case_id) / count(*), 6) AS recall, CASE WHEN count(m.case_id) / count(*) < 0.8 OR count(CASE WHEN adjudicated AND m.case_id IS NULL THEN 1 END) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict
FROM g LEFT JOIN m USING (case_id)""")(lambda spark, sf_dir: reconcile.gold_recall(facts(spark, sf_dir).where("source_type = 'warn'").select(F.col("id").alias("case_id"), (F.col("id") % 3 == 0).alias("adjudicated")), facts(spark, sf_dir).where("id % 10 < 9").select(F.col("id").alias("case_id")), 0.8))
query("pooled_recall", """, s AS (SELECT state, count(CASE WHEN review_status = 'approved' AND state <> 'AA' THEN 1 END) AS h, count(CASE WHEN review_status <> 'pending' AND state <> 'AA' THEN 1 END) AS j, count(*) AS p FROM ledger WHERE source_type = 'warn' GROUP BY 1)
SELECT CAST(sum(CASE WHEN j > 0 THEN h END) AS BIGINT) AS hits, CAST(sum(CASE WHEN j > 0 THEN j END) AS BIGINT) AS judged, count(CASE WHEN j = 0 THEN 1 END) AS unjudged, round(sum(CASE WHEN j > 0 THEN h END) / sum(CASE WHEN j > 0 THEN j END), 6) AS recall,
  round(sum(CASE WHEN j > 0 THEN h / j * p END) / sum(CASE WHEN j > 0 THEN p END), 6) AS weighted_recall FROM s""")(
    lambda spark, sf_dir: reconcile.pooled_recall(facts(spark, sf_dir).where("source_type = 'warn'").groupBy(F.col("state").alias("stratum")).agg(
        F.count(F.expr("CASE WHEN review_status = 'approved' AND state <> 'AA' THEN 1 END")).alias("hits"), F.count(F.expr("CASE WHEN review_status <> 'pending' AND state <> 'AA' THEN 1 END")).alias("judged"), F.count(F.lit(1)).alias("population"))))


def slices(spark, sf_dir):
    """Jobs by country before and after, of two recorder runs."""
    rows = facts(spark, sf_dir).where(ONCE)
    return rows.groupBy(F.col("country").alias("slice")).agg(F.sum(F.expr("CASE WHEN id % 9 <> 0 THEN job_count END")).alias("was"), F.sum(F.expr("CASE WHEN country <> 'NATION_7' OR id % 4 = 0 THEN job_count END")).alias("now")).withColumn("run", F.when(F.col("slice") == "NATION_3", "b").otherwise("a"))


_SLICES = f", s AS (SELECT country AS slice, CAST(sum(CASE WHEN id % 9 <> 0 THEN job_count END) AS BIGINT) AS was, CAST(sum(CASE WHEN country <> 'NATION_7' OR id % 4 = 0 THEN job_count END) AS BIGINT) AS now, CASE WHEN country = 'NATION_3' THEN 'b' ELSE 'a' END AS run FROM ledger WHERE {ONCE} GROUP BY 1)"
query("headline_movement", _SLICES + """ SELECT slice, was, CASE WHEN slice <> 'NATION_9' THEN now END AS now, CASE WHEN slice = 'NATION_7' THEN CAST(50 AS BIGINT) ELSE 0 END AS disclosed, CASE WHEN slice = 'NATION_9' THEN 'UNKNOWN' WHEN was - now - CASE WHEN slice = 'NATION_7' THEN 50 ELSE 0 END > 0.05 * was THEN 'FAIL' ELSE 'PASS' END AS verdict FROM s""")(
    lambda spark, sf_dir: (lambda s: reconcile.headline_movement(s.select("slice", F.col("was").alias("jobs")), s.where("slice <> 'NATION_9'").select("slice", F.col("now").alias("jobs")), s.where("slice = 'NATION_7'").select("slice", F.lit(50).cast("long").alias("jobs"))))(slices(spark, sf_dir)))
query("containment", _SLICES + """, p AS (SELECT * FROM (VALUES ('NATION_1', 'NATION_2'), ('NATION_7', 'NATION_3'), ('NATION_7', 'NATION_8'), ('NATION_4', 'NATION_6')) AS v(part, whole))
SELECT part, whole, (a.now - a.was) - (b.now - b.was) AS residual, CASE WHEN a.run <> b.run THEN 'UNKNOWN' WHEN a.now > b.now OR (a.now - a.was) - (b.now - b.was) > 25000 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM p JOIN s a ON part = a.slice JOIN s b ON whole = b.slice""")(
    lambda spark, sf_dir: reconcile.containment(slices(spark, sf_dir), spark.createDataFrame([("NATION_1", "NATION_2"), ("NATION_7", "NATION_3"), ("NATION_7", "NATION_8"), ("NATION_4", "NATION_6")], "part string, whole string")))
query("country_coverage", f""", o AS (SELECT country, count(*) AS entries, CAST(sum(job_count) AS BIGINT) AS jobs FROM ledger WHERE {ONCE} AND country <> '' AND country <> 'NATION_2' GROUP BY 1), r AS (SELECT n_name AS country, CASE WHEN n_nationkey % 5 = 0 THEN 'none' ELSE 'notice' END AS regime FROM nation WHERE n_nationkey <> 11)
SELECT coalesce(o.country, r.country) AS country, coalesce(entries, 0) AS entries, coalesce(jobs, 0) AS jobs, CASE WHEN regime IS NULL THEN 'UNCLASSIFIED' WHEN regime = 'none' THEN 'NO_REGIME' WHEN entries IS NULL THEN 'NOT_COVERED' ELSE 'COVERED' END AS class FROM o FULL JOIN r ON o.country = r.country""")(
    lambda spark, sf_dir: reconcile.country_coverage(facts(spark, sf_dir).where("country <> 'NATION_2'"), read(spark, sf_dir, "nation").where("n_nationkey <> 11").select(F.col("n_name").alias("country"), F.expr("CASE WHEN n_nationkey % 5 = 0 THEN 'none' ELSE 'notice' END").alias("regime"))))
query("city_recall", f""", c AS (SELECT id AS case_id, {pick(['Austin', 'Waco', 'Customer', 'Dallas'])} AS city, company, company_key, CASE WHEN id % 3 = 0 THEN job_count + 1 ELSE job_count END AS jobs, layoff_date + CAST(id % 60 AS INTEGER) AS day FROM ledger WHERE source_type = 'warn' AND layoff_date IS NOT NULL),
m AS (SELECT case_id, max(CASE WHEN jobs = job_count THEN 1 ELSE 0 END) AS exact FROM c JOIN ledger l ON c.company_key = l.company_key AND abs(datediff('day', day, layoff_date)) <= 45 WHERE city <> 'Customer' GROUP BY 1)
SELECT city, count(*) AS cases, count(CASE WHEN city = 'Customer' THEN 1 END) AS set_aside, count(CASE WHEN exact = 1 THEN 1 END) AS exact, count(exact) AS found FROM c LEFT JOIN m USING (case_id) GROUP BY 1""")(
    lambda spark, sf_dir: reconcile.city_recall(facts(spark, sf_dir).where("source_type = 'warn' AND layoff_date IS NOT NULL").select(F.col("id").alias("case_id"), picked(["Austin", "Waco", "Customer", "Dallas"]).alias("city"), "company",
        F.expr("CASE WHEN id % 3 = 0 THEN job_count + 1 ELSE job_count END").alias("jobs"), F.date_add("layoff_date", (F.col("id") % 60).cast("int")).alias("day")), facts(spark, sf_dir)))

query("concentration_verdict", f"""SELECT arg_max(id, (job_count, -id)) AS id, max(job_count) AS largest, CAST(sum(job_count) AS BIGINT) AS jobs, round(max(job_count) / sum(job_count), 6) AS share, CASE WHEN max(job_count) / sum(job_count) >= 0.2 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM ledger WHERE {ONCE}""")(
    lambda spark, sf_dir: reconcile.concentration_verdict(facts(spark, sf_dir), 0.2))
query("quote_precision", """SELECT count(*) AS rows, count(CASE WHEN id % 4 <> 0 THEN 1 END) AS quoted, count(CASE WHEN id % 4 = 1 THEN 1 END) AS named, round(100 * count(CASE WHEN id % 4 = 1 THEN 1 END) / count(*), 1) AS rate_pct FROM ledger WHERE ai_explicit""")(
    lambda spark, sf_dir: reconcile.quote_precision(facts(spark, sf_dir).withColumn("quote", F.expr("CASE id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'replaced by AI tools' WHEN 2 THEN 'technology-enabled efficiency' ELSE 'said the chairman' END")), "quote"))
query("panel_verdicts", """, v AS (SELECT company_key AS case_id, job_count AS jobs, CASE WHEN id % 11 = 0 THEN FALSE WHEN id % 13 = 0 THEN NULL ELSE TRUE END AS approve, id % 17 <> 0 AS cited FROM ledger)
SELECT case_id, count(*) AS votes, CASE WHEN count(CASE WHEN NOT approve THEN 1 END) > 0 THEN 'REJECT' WHEN count(CASE WHEN approve AND cited THEN 1 END) = count(*) AND max(jobs) < 3000 THEN 'AUTO_APPLY' ELSE 'HOLD_FOR_REVIEW' END AS verdict FROM v GROUP BY 1""")(
    lambda spark, sf_dir: reconcile.panel_verdicts(facts(spark, sf_dir).select(F.col("company_key").alias("case_id"), F.col("job_count").alias("jobs"), F.expr("CASE WHEN id % 11 = 0 THEN FALSE WHEN id % 13 = 0 THEN NULL ELSE TRUE END").alias("approve"), (F.col("id") % 17 != 0).alias("cited")), 3000))
query("recall_by_size", PLANTED_SQL + """, c AS (SELECT id AS case_id, company_key, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 4 = 0 THEN job_count // 10 ELSE job_count END AS jobs, layoff_date AS day FROM planted WHERE source_type = 'warn' AND layoff_date IS NOT NULL),
m AS (SELECT case_id, max(CASE WHEN jobs = job_count THEN 1 WHEN jobs IS NOT NULL THEN 0 END) AS exact FROM c JOIN planted p ON p.company_key = c.company_key AND p.source_type = 'news' AND abs(datediff('day', day, layoff_date)) <= 45 GROUP BY 1)
SELECT CASE WHEN jobs IS NULL THEN 'UNKNOWN' WHEN jobs >= 500 THEN 'L' WHEN jobs >= 100 THEN 'M' ELSE 'S' END AS band, count(*) AS cases, count(exact) AS candidates, count(CASE WHEN exact = 1 THEN 1 END) AS exact, round(100 * count(m.exact) / count(*), 1) AS candidate_pct FROM c LEFT JOIN m USING (case_id) GROUP BY 1""")(
    lambda spark, sf_dir: (lambda p: reconcile.recall_by_size(p.where("source_type = 'warn' AND layoff_date IS NOT NULL").select(F.col("id").alias("case_id"), "company_key", F.expr("CASE WHEN id % 9 = 0 THEN NULL WHEN id % 4 = 0 THEN job_count div 10 ELSE job_count END").alias("jobs"), F.col("layoff_date").alias("day")),
        p.where("source_type = 'news' AND layoff_date IS NOT NULL").select("company_key", "job_count", F.col("layoff_date").alias("day"))))(planted(spark, sf_dir)))

# Rows of the interface, follows, mutations -----------------------------------------------------------------------------------------------------

query("interface_rows", f"""SELECT id, company, CASE WHEN state <> '' THEN state || ', ' ELSE '' END || country AS location, {TIER} AS tier, array_to_string(reason_tags, '|') AS reasons, array_to_string(list_filter(role_categories, lambda x: x <> 'unknown'), '|') AS roles,
  CASE WHEN source_url <> '' AND status = 'archived' THEN '/archive/' || url_hash ELSE '' END AS archived_at FROM ledger LEFT JOIN archived ON md5(trim(source_url)) = url_hash""")(lambda spark, sf_dir: reconcile.interface_rows(facts(spark, sf_dir), tables.archive(spark, sf_dir)))
query("membership_flags", """SELECT id, superset_of = 0 AND country = 'NATION_5' AS by_place, superset_of = 0 AND CASE WHEN employer_country <> '' THEN employer_country ELSE country END = 'NATION_5' AS by_home, superset_of = 0 AND (country = 'NATION_5') <> (employer_country = 'NATION_5') AS union_only FROM ledger""")(
    lambda spark, sf_dir: reconcile.membership_flags(facts(spark, sf_dir), HOME))
query("follow_matches", """, w AS (SELECT *, coalesce(announcement_date, layoff_date) AS d FROM ledger WHERE superset_of = 0), r AS (SELECT * FROM w WHERE CAST(updated_at AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' OR d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'),
f AS (SELECT DISTINCT 's' || state AS follow_id, 'state' AS kind, state AS value FROM ledger WHERE state <> '' UNION ALL SELECT DISTINCT 'c' || company_key, 'company', company_key FROM ledger)
SELECT follow_id, id, row_number() OVER (PARTITION BY follow_id ORDER BY job_count DESC, id DESC) AS rank FROM f JOIN r ON CASE kind WHEN 'state' THEN state ELSE company_key END = value QUALIFY rank <= 10""")(
    lambda spark, sf_dir: reconcile.follow_matches(facts(spark, sf_dir), facts(spark, sf_dir).where("state <> ''").select(F.concat(F.lit("s"), "state").alias("follow_id"), F.lit("state").alias("kind"), F.col("state").alias("value")).distinct().unionByName(
        facts(spark, sf_dir).select(F.concat(F.lit("c"), "company_key").alias("follow_id"), F.lit("company").alias("kind"), F.col("company_key").alias("value")).distinct()), "1996-01-01", "1997-12-31"))
query("follow_city", f"""SELECT id, {pick(["AUSTIN", "Austin", "El Paso", "Waco"])} AS city FROM ledger WHERE source_type = 'warn' AND id % 7 > 1 AND lower({pick(["AUSTIN", "Austin", "El Paso", "Waco"])}) = 'austin'""")(
    lambda spark, sf_dir: notices(spark, sf_dir).select("id", reports.city(F.col("excerpt")).alias("city")).where(F.lower("city") == "austin"))
query("moved_reports", """, r AS (SELECT DISTINCT event_id, source_url, source_name, observed_at, line FROM reports)
SELECT DISTINCT CASE WHEN source_url <> '' AND event_id % 5 = 0 THEN event_id + 1 ELSE event_id END AS event_id, source_name, source_url, observed_at, line FROM r""")(
    lambda spark, sf_dir: reconcile.moved_reports(tables.reports(spark, sf_dir), tables.reports(spark, sf_dir).where("source_url <> '' AND event_id % 5 = 0").select("source_url", F.col("event_id").alias("from_event"), (F.col("event_id") + 1).alias("to_event"))))
query("backfilled_industry", """SELECT id, CASE WHEN industry = '' AND NOT edited AND id % 4 = 0 THEN 'Technology' ELSE industry END AS industry FROM ledger""")(
    lambda spark, sf_dir: reconcile.backfilled(facts(spark, sf_dir), facts(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 3, "Nonsense").otherwise("Technology").alias("value"), F.expr("CASE id % 4 WHEN 0 THEN upper(excerpt) WHEN 1 THEN 'jobs at' WHEN 2 THEN 'never stated there' ELSE excerpt END").alias("quote")), "industry", ("Technology", "Energy")).select("id", "industry"))
query("migrated_events", "SELECT id, id + 1000000000 AS event_id FROM ledger WHERE id % 3 = 0 AND id > 200 ORDER BY id LIMIT 100")(
    lambda spark, sf_dir: reconcile.migrated_events(facts(spark, sf_dir).withColumn("event_id", F.expr("CASE WHEN id % 3 = 0 THEN 0 ELSE event_id END")), 200, 100))
query("trashed_and_edited", "SELECT id, job_count + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS job_count, edited OR id % 6 = 0 AS edited FROM ledger WHERE id % 5 <> 0")(
    lambda spark, sf_dir: mutations.edited(mutations.trashed(facts(spark, sf_dir), facts(spark, sf_dir).where("id % 5 = 0").select("id")), facts(spark, sf_dir).where("id % 6 = 0").select("id", (F.col("job_count") + 1).alias("job_count"))).select("id", "job_count", "edited"))
query("normalised_column", "SELECT id, ['United States', 'United Kingdom', 'Multiple countries', 'Canada'][id % 4 + 1] AS country FROM ledger")(
    lambda spark, sf_dir: mutations.normalised_column(facts(spark, sf_dir).withColumn("country", picked(["USA", "England", "US, UK", "Quebec"])), "country").select("id", "country"))
query("collected", """SELECT 'news' AS collector, id, company, job_count FROM ledger WHERE source_type = 'news' UNION ALL SELECT 'warn', id, company, NULL FROM ledger WHERE source_type = 'warn'""")(
    lambda spark, sf_dir: reconcile.collected({"news": facts(spark, sf_dir).where("source_type = 'news'").select("id", "company", "job_count"), "warn": facts(spark, sf_dir).where("source_type = 'warn'").select("company", "id")}, ["id", "company", "job_count"]))
query("audience_order", """, g AS (SELECT country, company AS label, count(*) AS notices, CAST(sum(job_count) AS BIGINT) AS jobs FROM ledger GROUP BY 1, 2) SELECT * FROM g ORDER BY country <> 'NATION_5', jobs DESC, notices DESC, label LIMIT 40""")(
    lambda spark, sf_dir: reconcile.audience_order(facts(spark, sf_dir).groupBy("country", F.col("company").alias("label")).agg(F.count(F.lit(1)).alias("notices"), F.sum("job_count").alias("jobs")), HOME).limit(40))
query("complement_identity", f"""SELECT {jobs(ONCE)} AS counted, {jobs('superset_of <> 0')} AS excluded, CAST(sum(job_count) AS BIGINT) AS everything, {jobs(ONCE)} + {jobs('superset_of <> 0')} = sum(job_count) AS holds FROM ledger""")(
    lambda spark, sf_dir: facts(spark, sf_dir).agg(F.sum(F.expr(f"CASE WHEN {ONCE} THEN job_count END")).alias("counted"), F.sum(F.expr("CASE WHEN superset_of <> 0 THEN job_count END")).alias("excluded"), F.sum("job_count").alias("everything")).withColumn("holds", F.col("counted") + F.col("excluded") == F.col("everything")))
