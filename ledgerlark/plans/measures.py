"""The registered queries over series, quality measures, texts, exports and streams, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, quality, series
from ..operators.filters import FilterSpec
from ..sources import ledger as tables
from ..sources import sinks
from ..sources.ledger import AS_OF, read
from ..streaming import jobs as streams
from ..streaming import snapshots, stateful
from .catalogue import MEASURES, ONCE, facts, jobs, n, query
from .planted import PLANTED_SQL, planted

# Series ---------------------------------------------------------------------------------------------------------------------------

_MONTHS = f", m AS (SELECT strftime(layoff_date, '%Y-%m') AS month, {jobs()} AS jobs, {jobs('ai_explicit')} AS ai_jobs FROM ledger WHERE {ONCE} AND layoff_date IS NOT NULL GROUP BY 1)"


def months(spark, sf_dir):
    return aggregates.series(facts(spark, sf_dir), "effective", AS_OF).select("month", "jobs", "ai_jobs")


query("series_filled", _MONTHS + f""", e AS (SELECT strftime(unnest(generate_series((SELECT min(strptime(month || '-01', '%Y-%m-%d')) FROM m), (SELECT least(max(strptime(month || '-01', '%Y-%m-%d')), date_trunc('month', TIMESTAMP '{AS_OF}')) FROM m), INTERVAL 1 MONTH)), '%Y-%m') AS month)
SELECT month, coalesce(jobs, 0) AS jobs FROM e LEFT JOIN (SELECT * FROM m WHERE month <> '1996-05') USING (month)""")(lambda spark, sf_dir: series.filled(months(spark, sf_dir).where("month <> '1996-05'"), "jobs", AS_OF))
query("series_cumulative", _MONTHS + " SELECT * FROM (SELECT month, CAST(sum(ai_jobs) OVER (ORDER BY month) AS BIGINT) AS running FROM m) WHERE running > 0")(lambda spark, sf_dir: series.cumulative(months(spark, sf_dir), "ai_jobs"))
query("series_ai_share", _MONTHS + " SELECT month, CASE WHEN jobs > 0 THEN round(100 * ai_jobs / jobs, 1) END AS pct FROM m")(lambda spark, sf_dir: series.share(months(spark, sf_dir), "ai_jobs", "jobs"))
query("series_yoy", _MONTHS + """ SELECT month[6:7] AS month, CAST(sum(CASE WHEN month[1:4] = '1996' THEN jobs END) AS BIGINT) AS y1996, CAST(sum(CASE WHEN month[1:4] = '1997' THEN jobs END) AS BIGINT) AS y1997, CAST(sum(CASE WHEN month[1:4] = '1998' THEN jobs END) AS BIGINT) AS y1998 FROM m GROUP BY 1""")(
    lambda spark, sf_dir: series.year_over_year(months(spark, sf_dir), "jobs", [1996, 1997, 1998]))
query("series_compare", f"SELECT strftime(layoff_date, '%Y-%m') AS month, country AS label, CAST(sum(job_count) AS BIGINT) AS jobs FROM ledger WHERE {ONCE} AND layoff_date IS NOT NULL AND country <> '' GROUP BY 1, 2")(
    lambda spark, sf_dir: series.compare(facts(spark, sf_dir), "country"))
_WEEKS = ", w AS (SELECT date_trunc('week', l_shipdate) AS week, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1), v AS (SELECT strftime(week, '%Y-%m') AS month, {agg} AS value, count(*) AS weeks FROM w GROUP BY 1)"


def weeks(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.date_trunc("week", F.col("l_shipdate")).alias("week")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))


for _name, _agg, _flow in (("weekly_to_monthly", "CAST(sum(value) AS BIGINT)", True), ("weekly_to_monthly_stock", "round(avg(value), 6)", False)):
    query(_name, _WEEKS.format(agg=_agg) + " SELECT * FROM v WHERE NOT (month = (SELECT max(month) FROM v) AND weeks < (SELECT quantile_cont(weeks, 0.5) FROM v))")(
        lambda spark, sf_dir, flow=_flow: (lambda df: df if flow else df.withColumn("value", F.round("value", 6)))(series.weekly_to_monthly(weeks(spark, sf_dir), flow)))
_POINTS = f", p AS (SELECT industry AS series, strftime(layoff_date, '%Y-%m') AS month, CAST(sum(job_count) AS BIGINT) AS value FROM ledger WHERE {ONCE} AND layoff_date IS NOT NULL AND industry <> '' GROUP BY 1, 2)"
_CHANGE = _POINTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS k FROM p),
g AS (SELECT series, max(k) AS points, avg(CASE WHEN k <= 3 THEN value END) AS a, avg(CASE WHEN k BETWEEN 4 AND 15 THEN value END) AS b FROM r GROUP BY 1),
d AS (SELECT series, points, CASE WHEN points >= 15 AND b > 0 THEN round(a / b - 1, 6) END AS change FROM g),
x AS (SELECT *, CASE WHEN change >= 0.05 THEN 'up' WHEN change <= -0.05 THEN 'down' WHEN change IS NOT NULL THEN 'flat' END AS direction FROM d)"""


def points(spark, sf_dir):
    return series.compare(facts(spark, sf_dir), "industry").select(F.col("label").alias("series"), "month", F.col("jobs").alias("value"))


query("change_3v12", _CHANGE + " SELECT * FROM x")(lambda spark, sf_dir: series.recent_change(points(spark, sf_dir)))
query("status_vote", _CHANGE + """, u AS (SELECT length(series) % 2 AS g, count(CASE WHEN direction = 'up' THEN 1 END) AS up, count(CASE WHEN direction = 'down' THEN 1 END) AS down, count(direction) AS judged FROM x GROUP BY 1)
SELECT *, CASE WHEN judged < 2 THEN NULL WHEN up >= 2 AND up > down THEN 'heating' WHEN down >= 2 AND down > up THEN 'cooling' ELSE 'stable' END AS status FROM u""")(
    lambda spark, sf_dir: series.status_vote(series.recent_change(points(spark, sf_dir)).withColumn("g", F.length("series") % 2), "g"))
query("index_100", _POINTS + " SELECT series, month, round(100 * value / avg(value) OVER (PARTITION BY series), 6) AS indexed FROM p")(lambda spark, sf_dir: series.indexed(points(spark, sf_dir)))
query("same_quarter", f""", q AS (SELECT country AS series, year(layoff_date) AS year, quarter(layoff_date) AS quarter, CAST(sum(job_count) AS BIGINT) AS value FROM ledger WHERE {ONCE} AND layoff_date IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY series ORDER BY year DESC, quarter DESC) = 1)
SELECT l.series, l.year, l.quarter, CASE WHEN b.value > 0 THEN round(l.value / b.value - 1, 6) END AS change FROM l LEFT JOIN q b ON b.series = l.series AND b.year = l.year - 1 AND b.quarter = l.quarter""")(
    lambda spark, sf_dir: series.same_quarter_change(facts(spark, sf_dir).where("superset_of = 0 AND layoff_date IS NOT NULL").groupBy(F.col("country").alias("series"), F.year("layoff_date").alias("year"), F.quarter("layoff_date").alias("quarter")).agg(F.sum("job_count").alias("value"))))

# Quality --------------------------------------------------------------------------------------------------------------------------

_CADENCE = """, o AS (SELECT CASE WHEN id % 23 = 0 AND year(layoff_date) < 1993 THEN 'thin' ELSE source_name END AS source, layoff_date AS day, 1 AS x FROM ledger WHERE layoff_date IS NOT NULL),
w AS (SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY source) AS newest FROM o) WHERE newest - day <= 1095), p AS (SELECT source, day, any_value(newest) AS newest, count(*) AS n FROM w GROUP BY 1, 2),
g AS (SELECT *, datediff('day', lag(day) OVER (PARTITION BY source ORDER BY day), day) AS gap FROM p),
a AS (SELECT source, CAST(sum(n) AS BIGINT) AS seen, count(*) AS days, min(day) AS first_day, max(day) AS last_day, quantile_disc(gap, 0.9) AS gap90, max(gap) AS longest_gap, sum(CASE WHEN newest - day <= 365 THEN n END) AS rs, max(CASE WHEN newest - day <= 365 THEN day END) - min(CASE WHEN newest - day <= 365 THEN day END) AS rspan FROM g GROUP BY 1),
b AS (SELECT *, CASE WHEN seen >= 8 AND days >= 7 AND last_day - first_day >= 180 THEN round((seen - 1) / (last_day - first_day) * 365, 2) END AS long_run, greatest(DATE '2001-12-01' - last_day, 0) AS days_dark FROM a),
c AS (SELECT *, CASE WHEN long_run IS NOT NULL THEN coalesce(CASE WHEN rs >= 8 AND rspan >= 120 THEN round((rs - 1) / rspan * 365, 2) END, long_run) END AS per_year FROM b)
SELECT source, seen, days, first_day, last_day, gap90, longest_gap, long_run, per_year, coalesce(per_year < 0.6 * long_run, FALSE) AS slowed, days_dark,
  CASE WHEN per_year IS NULL OR gap90 IS NULL THEN 'UNKNOWN' WHEN days_dark < 14 OR exp(-per_year / 365 * days_dark) >= 0.05 OR days_dark <= 1.25 * gap90 THEN 'PASS' WHEN exp(-per_year / 365 * days_dark) >= 0.01 THEN 'QUIET' ELSE 'FAIL' END AS verdict FROM c"""
query("cadence_profile", _CADENCE)(lambda spark, sf_dir: quality.cadence_profile(
    facts(spark, sf_dir).where("layoff_date IS NOT NULL").select(F.expr("CASE WHEN id % 23 = 0 AND year(layoff_date) < 1993 THEN 'thin' ELSE source_name END").alias("source"), F.col("layoff_date").alias("day")), "2001-12-01"))
query("zero_streak", """, z AS (SELECT source, max(CASE WHEN entries > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY attempted_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS stored FROM runs)
SELECT source, count(CASE WHEN stored = 0 THEN 1 END) AS streak, count(*) AS runs FROM z GROUP BY 1""")(lambda spark, sf_dir: quality.zero_streaks(tables.source_runs(spark, sf_dir)))
query("source_latest", "SELECT source, status, entries, attempted_at FROM runs QUALIFY row_number() OVER (PARTITION BY source ORDER BY attempted_at DESC, id DESC) = 1")(lambda spark, sf_dir: quality.latest_health(tables.source_runs(spark, sf_dir)))
query("run_tallies", f"SELECT source, {n(chr(39).join(['status = ', 'degraded', '']))} AS degraded, {n(chr(39).join(['status = ', 'ok', '']))} AS ok, {n(chr(39).join(['status = ', 'running', '']))} AS running FROM runs GROUP BY 1")(
    lambda spark, sf_dir: quality.run_tallies(tables.source_runs(spark, sf_dir)))
query("systematic_sample", """, r AS (SELECT id, layoff_date AS day, company AS employer, row_number() OVER (ORDER BY layoff_date NULLS FIRST, company, id) - 1 AS place, greatest(1, count(*) OVER () // 100) AS k FROM ledger WHERE source_type = 'warn')
SELECT id, day, employer, place FROM r WHERE place >= 17 % k AND (place - 17 % k) % k = 0 AND place < 17 % k + 100 * k""")(
    lambda spark, sf_dir: quality.systematic_sample(facts(spark, sf_dir).where("source_type = 'warn'").select("id", F.col("layoff_date").alias("day"), F.col("company").alias("employer")), 100, 17))
query("reference_events", """SELECT state, company_key, announcement_date, CAST(sum(job_count) AS BIGINT) AS jobs, min(layoff_date) AS first_effect, max(layoff_date) AS last_effect, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS components
  FROM ledger WHERE source_type = 'warn' GROUP BY 1, 2, 3""")(lambda spark, sf_dir: quality.reference_events(facts(spark, sf_dir).where("source_type = 'warn'")))
_Z = "(h / j + {z2} / (2 * j) {s} {z} * sqrt(h / j * (1 - h / j) / j + {z2} / (4 * j * j))) / (1 + {z2} / j)"


def _bound(sign: str) -> str:
    return _Z.format(s=sign, z="1.959964", z2="(1.959964 * 1.959964)")


query("recall_strata", f""", t AS (SELECT state AS stratum, count(CASE WHEN review_status = 'approved' THEN 1 END) AS h, count(CASE WHEN review_status <> 'pending' THEN 1 END) AS j, count(CASE WHEN review_status = 'pending' THEN 1 END) AS u,
  sum(CASE WHEN review_status = 'approved' THEN job_count END) AS hj, sum(CASE WHEN review_status <> 'pending' THEN job_count END) AS aj FROM ledger WHERE source_type = 'warn' GROUP BY 1)
SELECT stratum, h AS hits, j AS judged, u AS undecidable, CASE WHEN j > 0 THEN round(100 * h / j, 1) END AS rate_pct, CASE WHEN j > 0 THEN round(greatest(0, {_bound('-')}), 6) END AS low, CASE WHEN j > 0 THEN round(least(1, {_bound('+')}), 6) END AS high,
  CASE WHEN aj > 0 THEN round(100 * hj / aj, 1) END AS weighted_pct, CASE WHEN j = 0 THEN 'UNKNOWN' ELSE 'MEASURED' END AS state FROM t""")(
    lambda spark, sf_dir: quality.recall_by_stratum(facts(spark, sf_dir).where("source_type = 'warn'").select(F.col("state").alias("stratum"), F.col("job_count").alias("jobs"), F.when(F.col("review_status") != "pending", F.col("review_status") == "approved").alias("hit"))))
@query("recall_bands", PLANTED_SQL + """, r AS (SELECT id AS ref_id, job_count AS ref_jobs, company_key FROM planted WHERE source_type = 'warn'), m AS (SELECT ref_id, max(CASE WHEN l.job_count = ref_jobs THEN 1 ELSE 0 END) AS same FROM r JOIN planted l ON l.company_key = r.company_key AND l.source_type = 'news' AND l.job_count % 3 = 0 GROUP BY 1)
SELECT CASE same WHEN 1 THEN 'CONFIRMED' WHEN 0 THEN 'PROPOSED' ELSE 'ABSENT' END AS band, count(*) AS events FROM r LEFT JOIN m USING (ref_id) GROUP BY 1""")
def _(spark, sf_dir):
    rows = planted(spark, sf_dir)
    refs = rows.where("source_type = 'warn'").select(F.col("id").alias("ref_id"), F.col("job_count").alias("ref_jobs"), "company_key")
    matches = refs.join(rows.where("source_type = 'news' AND job_count % 3 = 0").select("company_key", "job_count"), "company_key").select("ref_id", "job_count")
    return quality.recall_bands(refs, matches)


query("count_precision", f""", t AS (SELECT source_type, count(CASE WHEN id % 4 <> 3 THEN 1 END) AS j, count(CASE WHEN id % 4 = 0 THEN 1 END) AS h FROM ledger GROUP BY 1)
SELECT source_type, h AS hits, j AS judged, round(greatest(0, {_bound('-')}), 6) AS low, round(least(1, {_bound('+')}), 6) AS high FROM t""")(
    # Excerpts that state the count, a longer number that begins with it, no number at all, and none.
    lambda spark, sf_dir: quality.count_precision(facts(spark, sf_dir).withColumn("excerpt", F.expr("CASE id % 4 WHEN 0 THEN excerpt WHEN 1 THEN concat('Notice of ', job_count, '7 jobs') WHEN 2 THEN 'Notice of jobs' ELSE '' END"))))
@query("coverage_band", """, d AS (SELECT n_name AS country, CASE WHEN n_nationkey % 5 = 0 AND x = 1 THEN 'events' ELSE 'jobs' END AS unit, 1000000 + n_nationkey AS total FROM nation, (SELECT unnest([0, 1]) AS x)),
o AS (SELECT country, count(DISTINCT unit) AS units, sum(total) AS total FROM d GROUP BY 1), h AS (SELECT country, employer_country, job_count FROM ledger WHERE superset_of = 0),
s AS (SELECT c AS country, sum(CASE WHEN own THEN job_count END) AS a, sum(job_count) AS b FROM (SELECT country AS c, TRUE AS own, job_count FROM h UNION ALL SELECT employer_country, FALSE, job_count FROM h WHERE employer_country NOT IN ('', country)) GROUP BY 1)
SELECT o.country, CASE WHEN units = 1 THEN round(100 * a / total, 1) END AS low_pct, CASE WHEN units = 1 THEN round(100 * b / total, 1) END AS high_pct, CASE WHEN units = 1 THEN 'MEASURED' ELSE 'UNKNOWN' END AS state FROM o LEFT JOIN s ON s.country = o.country""")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("x"))
    unit = F.when((F.col("n_nationkey") % 5 == 0) & (F.col("x") == 1), "events").otherwise("jobs")
    return quality.coverage_band(facts(spark, sf_dir), rows.select(F.col("n_name").alias("country"), unit.alias("unit"), (1000000 + F.col("n_nationkey")).alias("total")))


@query("ratchet_baselines", """, b AS (SELECT state, count(*) AS baseline FROM ledger WHERE source_type = 'warn' AND state <> 'AA' GROUP BY 1), c AS (SELECT state, count(*) AS n FROM ledger WHERE source_type = 'warn' AND id % 10 < CASE WHEN state < 'C' THEN 8 ELSE 10 END AND state <> 'BB' GROUP BY 1)
SELECT coalesce(b.state, c.state) AS state, coalesce(n, 0) AS n, greatest(coalesce(baseline, 0), coalesce(n, 0)) AS baseline, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n < 0.9 * coalesce(baseline, 0) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM b FULL JOIN c ON b.state = c.state""")
def _(spark, sf_dir):
    rows = facts(spark, sf_dir).where("source_type = 'warn'")
    before = rows.where("state <> 'AA'").groupBy("state").agg(F.count(F.lit(1)).alias("baseline"))
    return quality.ratchet(before, rows.where("id % 10 < CASE WHEN state < 'C' THEN 8 ELSE 10 END AND state <> 'BB'").groupBy("state").agg(F.count(F.lit(1)).alias("n")))


@query("latest_decisions", """, e AS (SELECT conv_id AS case_id, turn AS seq, CASE WHEN turn % 3 = 2 THEN 'revert' ELSE 'decide' END AS action, role AS verdict FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) = 1)
SELECT case_id, count(*) AS steps, CASE WHEN arg_max(action, seq) = 'revert' THEN 'OPEN' ELSE arg_max(verdict, seq) END AS verdict FROM e GROUP BY 1""")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(F.col("conv_id").alias("case_id"), F.col("turn").alias("seq")).agg(F.min("role").alias("verdict"))
    return quality.latest_decisions(rows.withColumn("action", F.when(F.col("seq") % 3 == 2, "revert").otherwise("decide")))


query("source_dating", "SELECT source_type, count(*) AS entries, round(avg(CASE WHEN layoff_date IS NOT NULL THEN 1 ELSE 0 END), 6) AS dated_share FROM ledger GROUP BY 1")(lambda spark, sf_dir: quality.source_dating(facts(spark, sf_dir)))

# Texts and exports ------------------------------------------------------------------------------------------------------------------

query("first_number", "SELECT id, CAST(regexp_extract(excerpt, '(\\d+)', 1) AS BIGINT) AS found FROM ledger")(lambda spark, sf_dir: facts(spark, sf_dir).select("id", text.first_number(F.col("excerpt")).alias("found")))
query("url_host", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^\w+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages")(lambda spark, sf_dir: read(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("host")))
query("latin_share", r"SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN len(regexp_extract_all(text, '\p{Latin}')) / len(regexp_extract_all(text, '\p{L}')) END, 6) AS share FROM documents")(
    lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", F.round(text.latin_share(F.col("text")), 6).alias("share")))
query("export_guarded", """SELECT id, CASE WHEN id % 4 = 0 THEN '''=' ELSE '' END || company AS company, array_to_string(reason_tags, '|') AS reasons, array_to_string(list_filter(role_categories, lambda x: x <> 'unknown'), '|') AS roles FROM ledger""")(
    lambda spark, sf_dir: sinks.export_rows(facts(spark, sf_dir).withColumn("company", F.when(F.col("id") % 4 == 0, F.concat(F.lit("="), "company")).otherwise(F.col("company")))).select("id", "company", "reasons", "roles"))
query("appendix_long", f""", a AS (SELECT 'country' AS section, country AS label, {MEASURES} FROM ledger WHERE {ONCE} GROUP BY 2 UNION ALL SELECT 'industry', industry, {MEASURES} FROM ledger WHERE {ONCE} AND industry <> '' GROUP BY 2)
SELECT section, label, metric, value FROM (UNPIVOT a ON jobs, ai_jobs, verified_jobs, verified_ai_jobs INTO NAME metric VALUE value)""")(
    lambda spark, sf_dir: sinks.appendix({c: aggregates.top(facts(spark, sf_dir), FilterSpec(), c) for c in ("country", "industry")}))

# Streams ------------------------------------------------------------------------------------------------------------------------------

query("stream_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")(streams.tumbling)
query("stream_sliding", """SELECT strftime(s, '%Y-%m-%d %H') AS start, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL (12 * k) HOUR FOR k IN [0, 1, 2]]) AS s FROM events) GROUP BY 1""")(streams.sliding)
query("stream_dedupe", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")(streams.deduplicated)
query("stream_health", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS last_run, max(ts) AS last_at, count(*) AS runs FROM events GROUP BY 1")(streams.health)
query("stream_sessions", """, g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""")(streams.sessions)
query("stream_ledger", """, s AS (SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, count(*) AS attempts, CASE WHEN count(CASE WHEN value > 95 THEN 1 END) > 0 THEN 'complete' WHEN count(CASE WHEN value > 90 THEN 1 END) > 0 THEN 'partial' WHEN count(*) >= 6 THEN 'failed' ELSE 'queued' END AS status FROM events GROUP BY 1, 2)
SELECT source, day, attempts, CASE WHEN status <> 'complete' AND day < max(CASE WHEN status = 'complete' THEN day END) OVER (PARTITION BY source) THEN 'superseded' ELSE status END AS status FROM s""")(streams.work_ledger)
query("stream_changed", "SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 3 DAY")(
    lambda spark, sf_dir: streams.changed(spark, sf_dir, str(read(spark, sf_dir, "events").agg(F.expr("min(ts) + INTERVAL 3 DAYS")).first()[0])))
query("stream_silence", """, h AS (SELECT event_type, max(ts) AS last_at FROM events GROUP BY 1), a AS (SELECT *, CAST(floor(epoch((SELECT max(ts) FROM events) + INTERVAL 1 HOUR - last_at) / 3600) AS BIGINT) AS hours FROM h)
SELECT event_type, last_at, hours, CASE WHEN hours > 1 THEN 'SILENT' ELSE 'OK' END AS verdict FROM a""")(
    lambda spark, sf_dir: streams.silence(spark, sf_dir, str(read(spark, sf_dir, "events").agg(F.expr("max(ts) + INTERVAL 1 HOUR")).first()[0]), 1))
query("json_lines", """SELECT id AS place, CAST(to_json({'id': id, 'company': company, 'job_count': job_count, 'country': country}) AS VARCHAR) AS line FROM ledger UNION ALL SELECT 0, CAST(to_json({'filters': 'all', 'rows': count(*)}) AS VARCHAR) FROM ledger""")(
    lambda spark, sf_dir: sinks.json_lines(facts(spark, sf_dir), "all"))
query("personal_data", r"""SELECT 'email' AS kind, count(CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 1 END) AS rows FROM documents UNION ALL
SELECT 'phone', count(CASE WHEN regexp_matches(text, '\+?\d{1,3}[ .-]\(?\d{2,4}\)?[ .-]\d{3}[ .-]\d{3,4}') THEN 1 END) FROM documents""")(
    lambda spark, sf_dir: sinks.personal_data(read(spark, sf_dir, "documents"), ["text"]))
query("stream_upsert", """, old AS (SELECT * FROM ledger WHERE id % 3 <> 0), fresh AS (SELECT id + 1000000 AS id, dedup_hash, job_count + 1 AS job_count, CASE WHEN id % 2 = 0 THEN '' ELSE 'NEW' END AS industry FROM ledger WHERE id % 5 = 0
  QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY id DESC) = 1)
SELECT coalesce(o.id, f.id) AS id, coalesce(o.dedup_hash, f.dedup_hash) AS dedup_hash, CASE WHEN f.id IS NULL OR coalesce(o.edited, FALSE) THEN o.job_count ELSE f.job_count END AS job_count,
  CASE WHEN f.id IS NULL OR coalesce(o.edited, FALSE) THEN o.industry ELSE coalesce(nullif(f.industry, ''), o.industry, f.industry) END AS industry FROM old o FULL JOIN fresh f ON o.dedup_hash = f.dedup_hash""")(
    lambda spark, sf_dir: snapshots.upserted_ledger(spark, sf_dir).select("id", "dedup_hash", "job_count", "industry"))
query("stream_zero_streak", """, last AS (SELECT source, max((attempted_at, id)) FILTER (entries > 0) AS newest FROM runs GROUP BY 1)
SELECT source, count(*) FILTER (entries = 0 AND (newest IS NULL OR (attempted_at, id) > newest)) AS streak, count(newest) > 0 AS stored_ever FROM runs JOIN last USING (source) GROUP BY 1""")(stateful.streaks_of)
