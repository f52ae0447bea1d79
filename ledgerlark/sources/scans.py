"""Lazy scans of reference files: every function takes paths or a table of texts and returns a typed DataFrame.

Parsing is done by Spark's readers and functions inside tasks, so a folder of files is one distributed scan. Broken records give
no rows or nulls, never an error; missing columns are read as nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_date, first_number, repaired_xml

# Words that tell what a column of a notice table is, in order of priority, and columns that never hold a count.
COMPANY_WORDS = ("company|employer|business|job_site|job site|organization|establishment|firm|location name", "title")
COUNT_WORDS = ("affected|laid off|expected layoff|revised layoff|total_layoff|layoff_number|workforce", "worker|headcount|jobs|job |emp #", "employee")
NO_COUNT = "address|site|county|zip|postal|code|reason|index|name|date|phone|area|region|wda|lwib|url|page|company|employer"
DATE_WORDS = ("effective|layoff date|separation", "notice|received", "date")
HEADERLESS = {"MD": "notice_date naics company address county affected effective_date layoff_type"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def columns_like(header: list[str], groups: tuple[str, ...], never: str = "") -> list[str]:
    """Columns whose name has a word of the first group, then of the next; none whose name has one of ``never``."""
    found: list[str] = []
    for group in groups:
        for name in header:
            low = name.lower().strip()
            if name not in found and any(w in low for w in group.split("|")) and not any(w in low for w in never.split("|") if w):
                found.append(name)
    return found


def first_filled(names: list[str], value=lambda c: F.when(F.trim(c) != "", F.trim(c))) -> Column:
    """The first of the columns with a value, in order; null where there is none."""
    return F.coalesce(F.lit(None), *[value(F.col(f"`{n}`")) for n in names])


def notices(rows: DataFrame, state: str) -> DataFrame:
    """Notices of one table with any header: employer, count and date from the columns whose names tell what they are.

    A positive count in a "revised" column wins. Rows without an employer or a count are left out.
    """
    header = rows.columns
    count = lambda c: F.when(first_number(c) > 0, first_number(c))
    revised = [n for n in columns_like(header, ("revised",), NO_COUNT)]
    jobs = F.coalesce(first_filled(revised, count), first_number(first_filled(columns_like(header, COUNT_WORDS, NO_COUNT))))
    out = rows.select(F.lit(state).alias("state"), first_filled(columns_like(header, COMPANY_WORDS)).alias("company"), jobs.cast("long").alias("job_count"), first_filled(columns_like(header, DATE_WORDS), any_date).cast("date").alias("day"))
    return out.where("company IS NOT NULL AND job_count > 0")


def notice_csv(spark: SparkSession, path: str, state: str) -> DataFrame:
    """One state's CSV; states that publish without a header get the names of their columns."""
    if names := HEADERLESS.get(state):
        rows = spark.read.schema(", ".join(f"{n} string" for n in names.split())).csv(path, header=False, multiLine=True, escape='"')
    else:
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return notices(rows, state)


#: Columns that are read of a notice table; further ones are left.
WIDTH = 48


def places_like(header: Column, groups: tuple[str, ...], never: str = "") -> Column:
    """``columns_like`` over an array of names: their places, in order of the groups."""
    low = lambda name: F.lower(F.trim(F.coalesce(name, F.lit(""))))
    holds = lambda name, words: F.coalesce(*[F.when(F.contains(low(name), F.lit(w)), F.lit(True)) for w in words.split("|") if w], F.lit(False))

    def of(words: str) -> Column:
        allowed = lambda name: holds(name, words) & ~(holds(name, never) if never else F.lit(False))
        return F.filter(F.transform(header, lambda name, i: F.when(allowed(name), i)), lambda i: i.isNotNull())

    return F.array_distinct(F.concat(*map(of, groups)))


def notice_folder(spark: SparkSession, paths: list[str], state: str = r"/([A-Z]{2})-") -> DataFrame:
    """Notices of a folder of tables, each with a header of its own: one scan, whatever the layouts.

    A table's header is its first record. What its columns are is worked out once a file, from the names alone; rows then look their
    values up by place. ``state`` is a pattern that finds the state in a file's path; tables of states without a header get its names.
    """
    names = [f"c{i}" for i in range(WIDTH)]
    read = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(paths, header=False, multiLine=True, escape='"', recursiveFileLookup=True)
    # A file of multi-line records is read by one task from its beginning, so its first record has the least number.
    rows = read.select(F.array(*names).alias("cells"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    files = rows.groupBy("file").agg(F.min_by("cells", "at").alias("first")).withColumn("state", F.regexp_extract("file", state, 1))
    fixed = F.coalesce(F.lit(None).cast("array<string>"), *[F.when(F.col("state") == s, F.array(*map(F.lit, n.split()))) for s, n in HEADERLESS.items()])
    header = F.coalesce(fixed, F.col("first"))
    plan = files.select(
        "file", "state", F.when(fixed.isNull(), F.col("first")).alias("header"), places_like(header, COMPANY_WORDS).alias("who"), places_like(header, ("revised",), NO_COUNT).alias("revised"),
        places_like(header, COUNT_WORDS, NO_COUNT).alias("jobs"), places_like(header, DATE_WORDS).alias("days"))
    # The engine takes an array of 48 cells for one text and would have all rows broadcast; there is one plan a file, and that is what travels.
    body = rows.join(F.broadcast(plan), "file").where(F.col("header").isNull() | ~F.col("cells").eqNullSafe(F.col("header")))
    filled = lambda places, value=lambda c: F.when(F.trim(c) != "", F.trim(c)): F.get(F.filter(F.transform(places, lambda i: value(F.get("cells", i))), lambda x: x.isNotNull()), 0)
    count = lambda c: F.when(first_number(c) > 0, first_number(c))
    jobs = F.coalesce(filled(F.col("revised"), count), first_number(filled(F.col("jobs"))))
    out = body.select("state", filled(F.col("who")).alias("company"), jobs.cast("long").alias("job_count"), filled(F.col("days"), any_date).cast("date").alias("day"))
    return out.where("company IS NOT NULL AND job_count > 0")


def separations(spark: SparkSession, path: str) -> DataFrame:
    """Federal separations, four columns of many; see ``reports.agency_months``."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("personnel_action_effective_date_yyyymm").cast("string").alias("yyyymm"), "agency", F.col("separation_category_code").alias("category"), F.col("count").cast("string").alias("count"))


def knowledge_graph(lines: DataFrame) -> DataFrame:
    """``lines (value)`` of tab-delimited article records with 27 fields: time, address, title and themes; other lines are dropped."""
    f = F.split("value", "\t")
    title = F.regexp_extract(f[26], r"(?i)<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1)
    out = lines.where(F.size(f) == 27).select(F.try_to_timestamp(f[1], F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("seen_at"), f[4].alias("url"), title.alias("title"), F.array_remove(F.split(f[7], ";"), "").alias("themes"))
    return out.where("url <> ''")


def feed_items(texts: DataFrame) -> DataFrame:
    """``texts (source, value)`` of RSS or Atom feeds, also with trailing junk or bare ampersands: source, title, link and time, one row per link."""
    block = F.regexp_extract_all(repaired_xml(F.col("value")), F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    items = texts.select("source", F.explode(block).alias("x"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "&lt;", "<"), "&amp;", "&"))
    tag = lambda t: plain(F.regexp_extract("x", rf"(?s)<{t}\b[^>]*>(.*?)</{t}>", 1))
    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.regexp_extract("x", r"<link\b[^>]*\bhref=\"([^\"]*)\"", 1))
    told = F.regexp_extract(tag("pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    at = F.coalesce(F.try_to_timestamp(told, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(F.substring(F.concat(tag("updated"), tag("published")), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    rows = items.select("source", tag("title").alias("title"), link.alias("link"), at.cast("timestamp_ntz").alias("at")).where("link <> ''")
    return rows.groupBy("link").agg(F.min_by(F.struct("source", "title", "at"), F.struct("at", "source", "title")).alias("f")).select("link", "f.*")


def api_candidates(texts: DataFrame, words: str) -> DataFrame:
    """``texts (value)`` of JSON answers with ``articles``: those whose title or description matches a pattern."""
    answer = F.from_json("value", "articles array<struct<source: struct<name: string>, title: string, description: string, url: string, publishedAt: string>>")
    rows = texts.select(F.explode(answer["articles"]).alias("a")).select(F.col("a.source.name").alias("source"), "a.title", "a.description", "a.url", F.try_to_timestamp("a.publishedAt").cast("timestamp_ntz").alias("at"))
    return rows.where(F.concat_ws(" ", "title", "description").rlike(words)).where("url <> ''")


def filings_index(spark: SparkSession, path: str, words: str) -> DataFrame:
    """A yearly index of filings, semicolon-separated: those whose subject matches, the latest version of each."""
    rows = spark.read.schema("company string, category string, subject string, received string, protocol string, version int, link string").csv(path, header=True, sep=";")
    day = F.try_to_date("received", "yyyy-MM-dd")
    rows = rows.where(F.col("subject").rlike(words)).select("company", "subject", day.alias("day"), "protocol", "version", "link")
    return rows.groupBy("protocol").agg(F.max_by(F.struct("company", "subject", "day", "version", "link"), "version").alias("f")).select("protocol", "f.*")


def json_stat(texts: DataFrame) -> DataFrame:
    """``texts (value)`` of JSON-stat 2.0 datasets: geo, period and value of every cell, its flat place turned into coordinates."""
    doc = F.from_json("value", "id array<string>, size array<int>, dimension map<string, struct<category: struct<index: map<string, int>>>>, value map<string, double>")
    rows = texts.select(doc.alias("d")).where("d.id IS NOT NULL AND array_contains(d.id, 'geo') AND array_contains(d.id, 'time')")
    cells = rows.select("d", F.explode("d.value").alias("flat", "value")).where("value IS NOT NULL").withColumn("n", F.col("flat").try_cast("long")).where("n IS NOT NULL")

    def position(name: str) -> Column:
        at = F.array_position("d.id", F.lit(name)).cast("int")
        inner = F.aggregate(F.slice("d.size", at + 1, F.size("d.size") - at), F.lit(1).cast("long"), lambda a, x: a * x)
        return F.floor(F.col("n") / inner) % F.element_at("d.size", at)

    def category(name: str) -> Column:
        index = F.map_entries(F.element_at(F.col("d.dimension"), name)["category"]["index"])
        return F.get(F.filter(index, lambda e: e["value"] == position(name)), 0)["key"]

    return cells.select(category("geo").alias("geo"), category("time").alias("period"), "value").where("geo IS NOT NULL AND period IS NOT NULL")


def sdmx_csv(spark: SparkSession, path: str) -> DataFrame:
    """Monthly, seasonally adjusted rates of an SDMX CSV; other measures, frequencies and blank values are dropped."""
    rows = spark.read.csv(path, header=True)
    fixed = {"MEASURE": "UNE_LF_M", "FREQ": "M", "ADJUSTMENT": "Y"}
    for name, value in fixed.items():
        if name in rows.columns:
            rows = rows.where(F.col(name).isNull() | (F.col(name) == value))
    rows = rows.where(F.trim("TIME_PERIOD").rlike(r"^\d{4}-(0[1-9]|1[0-2])$")).where("REF_AREA <> '' AND SEX <> '' AND AGE <> ''")
    return rows.select(F.col("REF_AREA").alias("area"), F.col("SEX").alias("sex"), F.col("AGE").alias("age"), F.trim("TIME_PERIOD").alias("month"), F.round(F.col("OBS_VALUE").try_cast("double"), 2).alias("value")).where("value IS NOT NULL")


def array_table(texts: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """``texts (value)`` of arrays of arrays whose first row is the header: named keys, and metrics as numbers; rows without any metric are dropped."""
    table = F.from_json("value", "array<array<string>>")
    rows = texts.select(table[0].alias("header"), F.explode(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))).alias("r"))
    named = lambda c: F.get("r", F.nullif(F.array_position("header", F.lit(c)), F.lit(0)).cast("int") - 1)
    out = rows.select(*[named(k).alias(k) for k in keys], *[F.floor(named(m).try_cast("double")).cast("long").alias(m) for m in metrics])
    return out.where(F.coalesce(*metrics).isNotNull())


def series_points(texts: DataFrame) -> DataFrame:
    """``texts (value)`` of monthly series answers: id, month, value and the flag of preliminary values; annual means and unpublished values are dropped."""
    answer = F.from_json("value", "status string, Results struct<series: array<struct<seriesID: string, data: array<struct<year: string, period: string, value: string, footnotes: array<struct<code: string>>>>>>>")
    rows = texts.select(answer.alias("a")).where("a.status = 'REQUEST_SUCCEEDED'").select(F.explode("a.Results.series").alias("s")).select("s.seriesID", F.explode("s.data").alias("p"))
    value = F.regexp_replace("p.value", ",", "").try_cast("double")
    flag = F.when(F.exists(F.coalesce("p.footnotes", F.array().cast("array<struct<code: string>>")), lambda x: F.coalesce(x["code"] == "P", F.lit(False))), "P").otherwise("")
    rows = rows.where(F.col("p.period").rlike("^M(0[1-9]|1[0-2])$"))
    return rows.select(F.col("seriesID").alias("series"), F.concat("p.year", F.lit("-"), F.substring("p.period", 2, 2)).alias("month"), value.alias("value"), flag.alias("flag")).where("value IS NOT NULL")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """A table of dated observations where a dot is a missing value."""
    rows = spark.read.schema("series string, date string, value string").csv(path, header=True)
    return rows.select("series", F.try_to_date("date", "yyyy-MM-dd").alias("day"), F.round(F.col("value").try_cast("double"), 3).alias("value")).where("day IS NOT NULL AND value IS NOT NULL")


def wide_months(spark: SparkSession, path: str, series: tuple[str, ...], since: str) -> DataFrame:
    """Adjusted totals with a column per month, as one row per month from a month on."""
    names = MONTHS.split()
    rows = spark.read.schema("sa string, naics_sector string, series string, geo string, year string, " + ", ".join(f"{m} string" for m in names)).csv(path, header=True)
    rows = rows.where(F.col("series").isin(*series)).where("trim(sa) = 'A' AND trim(naics_sector) = 'TOTAL' AND trim(geo) <> ''").withColumn("y", F.trim("year").try_cast("int")).where("y IS NOT NULL")
    long = rows.unpivot([F.trim("geo").alias("geo"), "series", "y"], names, "name", "raw")
    n = F.lpad((F.array_position(F.array(*map(F.lit, names)), F.col("name"))).cast("string"), 2, "0")
    out = long.select("geo", "series", F.concat("y", F.lit("-"), n).alias("month"), F.regexp_replace("raw", ",", "").try_cast("double").alias("value"))
    return out.where(F.col("value").isNotNull() & (F.col("month") >= since))


def last_of_week(rows: DataFrame, since: str) -> DataFrame:
    """``rows (series, day, value)``: the last observation of each series and ISO week."""
    rows = rows.where(F.col("day") >= F.to_date(F.lit(since)))
    out = rows.groupBy("series", F.date_trunc("week", F.col("day")).alias("week")).agg(F.max_by(F.struct("day", "value"), "day").alias("x"))
    return out.select("series", "x.day", "x.value")


def legal_entities(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Live, active entities with one row per filled name column: id, name, country."""
    live = rows.where("entity_status = 'ACTIVE' AND registration_status IN ('ISSUED', 'LAPSED')").where(F.col("lei").rlike("^[A-Z0-9]{18}[0-9]{2}$"))
    return live.select("lei", F.coalesce("country", F.lit("")).alias("country"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.when(F.trim(n) != "", F.trim(n)) for n in names])))).alias("name"))


def posts_to_rows(meta: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``meta (post_id, meta_id, key, value)``: one row per post with a column per key, the first value of each key by id."""
    first = meta.where(F.col("key").isin(*keys)).groupBy("post_id", "key").agg(F.min_by("value", "meta_id").alias("value"))
    return first.groupBy("post_id").pivot("key", list(keys)).agg(F.first("value"))
