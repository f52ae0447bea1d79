"""Queries of scans over texts that Spark writes from the given tables: feeds, answers of interfaces, datasets, record lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import spans
from ..operators import reconcile, similar
from ..sources import scans
from ..sources.ledger import read
from .catalogue import facts, query
from .lineage import cut, shared_dir
from .planted import pick, picked

FIRST_YEAR, YEARS = 1990, 20


@query("scan_json_stat", "SELECT country AS geo, CAST(year(layoff_date) AS VARCHAR) AS period, CAST(sum(job_count) AS DOUBLE) AS value FROM ledger WHERE layoff_date IS NOT NULL GROUP BY source_type, 1, 2")
def _(spark, sf_dir):
    """A dataset a source type, with a cell of bad place each; names of countries are texts that are no datasets."""
    nations = read(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("int")))).alias("geo"))
    years = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(YEARS - 1)), lambda i: F.struct((i + FIRST_YEAR).cast("string"), i)))
    cells = facts(spark, sf_dir).where("layoff_date IS NOT NULL").groupBy("source_type", "country", F.year("layoff_date").alias("year")).agg(F.sum("job_count").cast("double").alias("value")).crossJoin(F.broadcast(nations))
    flat = F.element_at("geo", F.col("country")) * YEARS + F.col("year") - FIRST_YEAR
    docs = cells.groupBy("source_type").agg(F.first("geo").alias("geo"), F.map_from_entries(F.collect_list(F.struct(flat.cast("string"), "value"))).alias("cells"))
    index = lambda m: F.struct(F.struct(m.alias("index")).alias("category"))
    one = F.map_from_entries(F.array(F.struct(F.lit("PC"), F.lit(0))))
    dims = F.map_from_entries(F.array(F.struct(F.lit("unit"), index(one)), F.struct(F.lit("geo"), index(F.col("geo"))), F.struct(F.lit("time"), index(years))))
    size = F.array(F.lit(1), F.size("geo"), F.lit(YEARS))
    text = F.to_json(F.struct(F.array(F.lit("unit"), F.lit("geo"), F.lit("time")).alias("id"), size.alias("size"), dims.alias("dimension"), F.map_concat("cells", F.map_from_entries(F.array(F.struct(F.lit("9x"), F.lit(1.0))))).alias("value")))
    return scans.json_stat(docs.select(text.alias("value")).unionByName(read(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))))


@query("scan_feeds", """, i AS (SELECT source_url, source_name, company || ' & Co cuts ' || job_count AS title, updated_at FROM ledger WHERE source_url <> '')
SELECT source_url AS link, arg_min(source_name, (updated_at, source_name, title)) AS source, arg_min(title, (updated_at, source_name, title)) AS title, min(updated_at) AS "at" FROM i GROUP BY 1""")
def _(spark, sf_dir):
    """A feed a desk and day, RSS or Atom by turns, with bare ampersands and junk behind the end."""
    title = F.concat("company", F.lit(" & Co cuts "), "job_count")
    rss = F.concat(F.lit("<item><title>"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("<![CDATA["), title, F.lit("]]>"))).otherwise(title), F.lit("</title><link>"), "source_url", F.lit("</link><pubDate>"), F.date_format("updated_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit('</title><link href="'), "source_url", F.lit('"/><updated>'), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))
    by_rss = F.dayofmonth("updated_at") % 2 == 0
    feeds = facts(spark, sf_dir).groupBy("source_name", F.to_date("updated_at").alias("day"), by_rss.alias("rss")).agg(F.array_join(F.collect_list(F.when(by_rss, rss).otherwise(atom)), "").alias("items"))
    return scans.feed_items(feeds.select(F.col("source_name").alias("source"), F.when(F.col("rss"), F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>trailing junk"))).otherwise(F.concat(F.lit("<feed>"), "items", F.lit("</feed>"))).alias("value")))


@query("scan_articles", """SELECT source_name AS source, excerpt AS title, CASE id % 3 WHEN 0 THEN 'mass layoffs at ' || company END AS description, source_url AS url, updated_at AS "at" FROM ledger WHERE id % 3 = 0 AND source_url <> ''""")
def _(spark, sf_dir):
    """An answer a country and day; a third of the articles name layoffs, a third another thing, a third say no more than their title."""
    about = F.when(F.col("id") % 3 == 0, F.concat(F.lit("mass layoffs at "), "company")).when(F.col("id") % 3 == 1, F.lit("playoffs"))
    article = F.struct(F.struct(F.col("source_name").alias("name")).alias("source"), F.col("excerpt").alias("title"), about.alias("description"), F.col("source_url").alias("url"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"))
    answers = facts(spark, sf_dir).groupBy("country", F.to_date("updated_at").alias("day")).agg(F.to_json(F.struct(F.collect_list(article).alias("articles"))).alias("value"))
    return scans.api_candidates(answers.select("value"), r"(?i)\blayoffs?\b")


@query("scan_array_table", """, q AS (SELECT year(layoff_date) || '-Q' || quarter(layoff_date) AS time, country AS state, count(*) AS n, sum(job_count) AS jobs FROM ledger WHERE layoff_date IS NOT NULL GROUP BY source_type, 1, 2)
SELECT time, state, CASE WHEN n % 5 > 0 THEN n END AS "Emp", CAST(CASE WHEN jobs % 3 > 0 THEN jobs END AS BIGINT) AS "Sep" FROM q WHERE n % 5 > 0 OR jobs % 3 > 0""")
def _(spark, sf_dir):
    """A table a source type, its header first; some cells are null, and so are whole rows."""
    rows = facts(spark, sf_dir).where("layoff_date IS NOT NULL").groupBy("source_type", F.concat(F.year("layoff_date"), F.lit("-Q"), F.quarter("layoff_date")).alias("time"), F.col("country").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("job_count").alias("jobs"))
    cells = F.array(F.when(F.col("n") % 5 > 0, F.col("n").cast("string")), F.when(F.col("jobs") % 3 > 0, F.concat(F.col("jobs").cast("string"), F.lit(".0"))), "time", "state")
    tables = rows.groupBy("source_type").agg(F.to_json(F.concat(F.array(F.array(*map(F.lit, ("Emp", "Sep", "time", "state")))), F.collect_list(cells))).alias("value"))
    return scans.array_table(tables.select("value"), ("time", "state"), ("Emp", "Sep"))


@query("scan_series", """, m AS (SELECT country AS series, strftime(layoff_date, '%Y-%m') AS month, CAST(sum(job_count) AS BIGINT) AS jobs FROM ledger WHERE layoff_date IS NOT NULL GROUP BY 1, 2)
SELECT series, month, CAST(jobs AS DOUBLE) AS value, CASE WHEN jobs % 2 = 0 THEN 'P' ELSE '' END AS flag FROM m WHERE jobs % 7 > 0""")
def _(spark, sf_dir):
    """A country's series of months, with its annual means, unpublished values and flags; a third of the answers tell of a failure besides."""
    months = facts(spark, sf_dir).where("layoff_date IS NOT NULL").groupBy("country", F.year("layoff_date").cast("string").alias("year"), F.date_format("layoff_date", "MM").alias("m")).agg(F.sum("job_count").alias("jobs"))
    notes = F.array(F.struct(F.when(F.col("jobs") % 2 == 0, "P").alias("code")))
    point = F.struct("year", F.concat(F.lit("M"), "m").alias("period"), F.when(F.col("jobs") % 7 == 0, "-").otherwise(F.format_number("jobs", 0)).alias("value"), notes.alias("footnotes"))
    mean = F.struct("year", F.lit("M13").alias("period"), F.lit("9").alias("value"), notes.alias("footnotes"))
    answers = months.groupBy("country").agg(F.flatten(F.collect_list(F.array(point, mean))).alias("data"))
    text = F.to_json(F.struct(F.lit("REQUEST_SUCCEEDED").alias("status"), F.struct(F.array(F.struct(F.col("country").alias("seriesID"), "data")).alias("series")).alias("Results")))
    return scans.series_points(answers.select(F.explode(F.array(text, F.lit('{"status": "REQUEST_FAILED"}'))).alias("value")))


@query("scan_knowledge_graph", """SELECT updated_at AS seen_at, source_url AS url, excerpt AS title, array_to_string(reason_tags, '|') AS themes FROM ledger WHERE source_url <> '' AND id % 10 <> 3""")
def _(spark, sf_dir):
    """A record line an entry, every tenth cut short."""
    fields = [F.col("id").cast("string"), F.date_format("updated_at", "yyyyMMddHHmmss"), F.lit("1"), F.col("source_name"), F.col("source_url"), F.lit(""), F.lit(""), F.concat(F.array_join("reason_tags", ";"), F.lit(";"))]
    line = F.concat_ws("\t", *fields, *[F.lit("")] * 18, F.concat(F.lit("<PAGE_TITLE>"), "excerpt", F.lit("</PAGE_TITLE>")))
    lines = facts(spark, sf_dir).select(F.when(F.col("id") % 10 == 3, F.substring_index(line, "\t", 20)).otherwise(line).alias("value"))
    return scans.knowledge_graph(lines).withColumn("themes", F.array_join("themes", "|"))


@query("containment_groups", """, m AS (SELECT r_name AS "group", r_name AS slice FROM region UNION SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT r_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT slice, min(slice) OVER (PARTITION BY "group") AS "group" FROM m""")
def _(spark, sf_dir):
    """Regions with their nations, and nations with their suppliers and customers: all of a region move together."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("part"), F.col("r_name").alias("whole"))
    for table, c in (("supplier", "s"), ("customer", "c")):
        pairs = pairs.unionByName(read(spark, sf_dir, table).join(nation, F.col(f"{c}_nationkey") == F.col("n_nationkey")).select(F.col(f"{c}_name").alias("part"), F.col("n_name").alias("whole")))
    return reconcile.containment_groups(pairs)


_NAME = "translate(substr(md5({0}), 1, 9), '0123456789', 'ghijklmnop') {2} ' ' {2} translate(substr(md5({0}), 12, 1{1}), '0123456789', 'qrstuvwxyz')"


@query("typo_pairs", f""", n AS (SELECT c_custkey AS id, {_NAME.format("c_name", 0, "||")} AS key FROM customer UNION ALL SELECT 1000000 + s_suppkey, {_NAME.format("s_name", 4, "||")} FROM supplier),
p AS (SELECT id, key FROM n UNION ALL SELECT id + 5000000, substr(key, 1, CAST(id % 8 AS INTEGER)) || substr(key, CAST(id % 8 AS INTEGER) + 2) FROM n WHERE id % 5 = 0 UNION ALL SELECT id + 7000000, substr(key, 1, 12) || 'zz' || substr(key, 13) FROM n WHERE id % 7 = 0)
SELECT CAST(least_a AS BIGINT) AS a_id, CAST(least_b AS BIGINT) AS b_id, a, b FROM (SELECT key AS a, min(id) AS least_a, length(key) AS na FROM p GROUP BY 1) JOIN (SELECT key AS b, min(id) AS least_b, length(key) AS nb FROM p GROUP BY 1)
  ON a < b AND abs(na - nb) <= 3 AND levenshtein(a, b) <= 3""")
def _(spark, sf_dir):
    """Names of customers and suppliers as letters of a digest; a fifth come again with a letter dropped, a seventh with two put in."""
    def named(table, key, name, more, shift):
        label = F.expr(f"concat(translate(substr(md5({name}), 1, 9), '0123456789', 'ghijklmnop'), ' ', translate(substr(md5({name}), 12, 1{more}), '0123456789', 'qrstuvwxyz'))")
        return read(spark, sf_dir, table).select((F.col(key) + shift).alias("id"), label.alias("key"))

    names = named("customer", "c_custkey", "c_name", 0, 0).unionByName(named("supplier", "s_suppkey", "s_name", 4, 1000000))
    dropped = names.where("id % 5 = 0").select((F.col("id") + 5000000).alias("id"), F.expr("concat(substr(key, 1, cast(id % 8 AS int)), substr(key, cast(id % 8 AS int) + 2))").alias("key"))
    doubled = names.where("id % 7 = 0").select((F.col("id") + 7000000).alias("id"), F.expr("concat(substr(key, 1, 12), 'zz', substr(key, 13))").alias("key"))
    return similar.typo_pairs(names.unionByName(dropped).unionByName(doubled))


_WORDS = list(spans.VOCABULARY)
_LANGUAGES, _TIERS = [spans.VOCABULARY[w][0] for w in _WORDS], [spans.VOCABULARY[w][1] for w in _WORDS]


@query("reduction_spans", f""", w AS (SELECT doc_id, least(10, length(coalesce(text, ''))) AS k, {pick(_WORDS, "doc_id")} AS word, {pick(_LANGUAGES, "doc_id")} AS language, {pick(_TIERS, "doc_id")} AS tier FROM documents)
SELECT doc_id, CAST(k + 1 AS BIGINT) AS start, CAST(k + 1 + length(word) + CASE doc_id % 4 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS "end", language, tier, word FROM w WHERE doc_id % 4 < 3 AND (length(word) >= 3 OR doc_id % 4 <> 1)""")
def _(spark, sf_dir):
    """All documents, with a word put into three of four: whole, broken by a line break and a space, or whole beside half-width forms."""
    word = picked(_WORDS, "doc_id")
    shown = F.when(F.col("doc_id") % 4 == 1, F.concat(F.substring(word, 1, 1), F.lit("\n\u3000"), F.expr("substr(w, 2)"))).when(F.col("doc_id") % 4 == 3, "\uff76\uff85").otherwise(F.concat(word, F.when(F.col("doc_id") % 4 == 2, " \uff76\uff85").otherwise("")))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", word)
    texts = docs.select("doc_id", F.concat(F.substring("text", 1, 10), F.lit(" "), shown, F.lit(" "), F.expr("substr(text, 11)")).alias("text"))
    found = texts.select("doc_id", F.explode(spans.reduction_spans(F.col("text"))).alias("s"))
    return found.select("doc_id", "s.start", "s.end", "s.language", "s.tier", "s.word")


#: Six layouts of notice tables: state, and columns by header.
LAYOUTS = {
    "IL": {"Location Name": "company", "WARN Notice": "'True'", "Expected Layoff": "format_number(job_count, 0)", "Revised Layoff": "CASE WHEN id % 5 = 0 THEN string(job_count + 1) ELSE '' END", "Company Address": "'12 Main St'",
           "Effective Date": "CASE WHEN id % 2 = 0 THEN date_format(held, 'M/d/yyyy') END", "Notice Date": "told", "Total Employees": "'99'"},
    "CA": {"County": "'Kern'", "Company": "company", "Employees Affected": "job_count", "Received Date": "told", "Effective Date": "held"},
    "TX": {"NOTICE_DATE": "told", "JOB_SITE_NAME": "company", "COUNTY_NAME": "'Bexar'", "TOTAL_LAYOFF_NUMBER": "job_count", "LayOff_Date": "held"},
    "NY": {"Date of Notice": "told", "Business Name": "concat(company, '\\n')", "Number of Workers": "concat(job_count, ' (about)')", "Reason": "'closure, 77 sites'"},
    "MD": {"notice_date": "told", "naics": "'1234'", "company": "company", "address": "'9 \"Elm\", Rd'", "county": "''", "affected": "job_count", "effective_date": "held", "layoff_type": "'Closure'"},
    "WA": {"# of Workers": "job_count", "Layoff Start Date": "held", "Employer": "company", "Received Date": "told", "Phone": "'555 1234'"},
}
_DAY = """CASE id % 6 WHEN 0 THEN CASE WHEN id % 2 = 0 AND held IS NOT NULL THEN held ELSE told END WHEN 1 THEN coalesce(held, told) WHEN 2 THEN coalesce(told, held) WHEN 3 THEN told WHEN 4 THEN coalesce(held, told) ELSE coalesce(told, held) END"""


@query("scan_notice_folder", f""", n AS (SELECT id, company, job_count, layoff_date + 11000 AS held, announcement_date + 11000 AS told FROM ledger WHERE source_type = 'warn')
SELECT {pick(list(LAYOUTS), "id")} AS state, company, CAST(CASE WHEN id % 30 = 0 THEN job_count + 1 ELSE job_count END AS BIGINT) AS job_count, {_DAY} AS day FROM n WHERE job_count > 0""")
def _(spark, sf_dir):
    """Some fifty files in six layouts, one of them without a header, written from the official notices and read in one scan."""
    home = f"{shared_dir(spark)}/notices-{uuid.uuid4().hex}"
    notices = facts(spark, sf_dir).where("source_type = 'warn'")
    rows = cut(notices.select("id", "company", "job_count", F.date_add("layoff_date", 11000).alias("held"), F.date_add("announcement_date", 11000).alias("told")))
    for k, (state, columns) in enumerate(LAYOUTS.items()):
        own = rows.where(f"id % 6 = {k}").repartition(9, "id").select(*[F.expr(e).cast("string").alias(c) for c, e in columns.items()])
        own.write.option("header", state != "MD").option("escape", '"').csv(f"{home}/{state}-tables")
    return scans.notice_folder(spark, [f"{home}/{state}-tables" for state in LAYOUTS])
