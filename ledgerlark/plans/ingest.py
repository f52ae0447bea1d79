"""Registered queries of ingest: normalisers, guards, validation and scans, each beside its DuckDB SQL.

The raw values are dealt to the ledger's rows round and round; the SQL names what each of them must become.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import employers, guards, normalise, text
from ..operators import quality, reconcile, reports, validation
from ..sources import ledger as tables
from ..sources import scans
from ..sources.ledger import read
from .catalogue import facts, query
from .planted import pick, picked

# Normalisers: what comes in, and what must come out -----------------------------------------------------------------------------------

COUNTRIES = {
    "US": "United States", " usa ": "United States", "U.S.A.": "United States", "United States (NJ)": "United States", "United States - New Jersey": "United States", "North Carolina": "United States",
    "Georgia": "Georgia", "Quebec": "Canada", "UK": "United Kingdom", "england": "United Kingdom", "Türkiye": "Türkiye", "Turkey": "Türkiye", "People's Republic of China": "China",
    "Republic of Korea": "South Korea", "Trinidad and Tobago": "Trinidad and Tobago", "India and US": "Multiple countries", "UK/Germany": "Multiple countries", "US, Canada": "Multiple countries",
    "Europe": "Multiple countries", "EMEA": "Multiple countries", "Asia Pacific": "Multiple countries", "Ruritania": "Ruritania", "": "", "United States Virgin Islands": "United States Virgin Islands",
    "Finland": "Finland", "District of Columbia": "United States", "worldwide": "Multiple countries", "France plus Spain": "Multiple countries", "Holland": "Holland",
}
INDUSTRIES = {
    "IT": "Technology", "biotech startup": "Healthcare & Pharma", "FinTech": "Finance & Insurance", "EdTech": "Education", "Boilers": "Boilers", "oil and gas": "Energy", "used cars": "Automotive",
    "Hotel/Restaurant": "Food & Hospitality", "Trailers": "Trailers", "rail freight": "Logistics & Transport", "Water / Waste": "Energy", "Adminstrative services": "Professional Services",
    "wood products": "Wood Products", "": "", "e-commerce": "Retail & E-commerce", "HR": "Professional Services", "Public Administration / Defence": "Government & Nonprofit", "cbd": "Consumer Goods",
    "video games": "Video Games", "gaming": "Media & Entertainment", "farming": "Farming", "farm": "Agriculture", "Paper mills": "Manufacturing", "AI/ML": "Technology",
}
ROLES = {
    "software engineers and recruiters": ["engineering", "hr_recruiting"], "People Operations": ["hr_recruiting"], "recruiting": ["hr_recruiting"], "IT staff": ["engineering"], "": [],
    "warehouse drivers": ["operations_warehouse"], "store associates and cashiers": ["retail_staff"], "Trust & Safety": ["content_trust_safety"], "unit managers": [],
    "product and design, sales": ["product_design", "sales_marketing"], "administrative assistants": ["finance_admin"], "assembly line": ["manufacturing"], "call center agents": ["customer_support"],
}
STATES = {"ca": "CA", "California": "CA", "N.Y.": "NY", "new  york": "NY", "District of Columbia": "DC", "Washington, DC": "", "washington dc": "DC", "Ontario": "", "": "", "Tex": "", " tx ": "TX", "W.Va": ""}
NOTICE_NAMES = {
    "Acme &amp; Sons, Inc.": "Acme & Sons, Inc.", "Green, LLC<br/></a><em>* Notice outlines several": "Green, LLC", "Update: Update: Beta Corp": "Beta Corp", "Update Marc Ltd": "Marc Ltd",
    "Update Software AG": "Update Software AG", "Walmart (1345 Crossman Ave.)": "Walmart", "Direct L.L.C. 200 St. Nazaire Rd. Broussard, LA, 70518": "Direct L.L.C.",
    "Winn Store No. 1411 5901 Airline Drive": "Winn Store", "Gamma Works RESCINDED": None, "Delta Foods - Cancelled": None, "  Plain   Name  ": "Plain Name", "12 Main Street": "12 Main Street",
}
ANONYMOUS = {
    "Unknown": True, "n/a": True, "None": True, "TBD": True, "not stated": True, "Various": True, "Various Eateries plc": False, "Automaker Giant": True, "Auto-parts giant": True, "Carrier": False,
    "DTC storage firm": True, "The GIANT Company, LLC": False, "Google parent": False, "Social media giant": True, "": True, "Deutsche Bank": False, "tech firm of the chips": True, "Public Storage": False,
}
KEYS = {
    "Amazon.com, Inc.": "amazon", "YouTube": "alphabet", "The Boeing Company": "boeing", "Oracle America, Inc.": "oracle", "GM": "general motors", "AWS Amazon": "amazon", "Société Générale": "soci t g n rale",
    "捷豹路虎": "jaguar land rover", "東京電力": "東京電力", "HP Inc": "hp", "Meta Platforms, Inc.": "meta", "Tata Motors' JLR": "jaguar land rover", "Saks Global": "saks", "  ": "", "Hewlett-Packard": "hp",
}


def dealt(name: str, table: dict, kernel, column: str, to: str = "VARCHAR") -> None:
    """A query that deals the keys of a table to the ledger's rows and gives what the kernel makes of them."""
    values = list(table.values())
    if to == "LIST":
        values = ["|".join(v) for v in values]
    kind = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", str: "VARCHAR"}[type(next(v for v in values if v is not None))]
    query(name, f"SELECT id, CAST({pick(values)} AS {kind}) AS {column} FROM ledger")(lambda spark, sf_dir: facts(spark, sf_dir).select("id", kernel(picked(list(table))).alias(column)))


dealt("normal_country", COUNTRIES, normalise.country, "country")
dealt("normal_industry", INDUSTRIES, normalise.industry, "industry")
dealt("normal_roles", ROLES, lambda c: F.array_join(normalise.roles(c), "|"), "roles", "LIST")
dealt("normal_state", STATES, normalise.state, "state")
dealt("notice_name", NOTICE_NAMES, normalise.notice_name, "company")
dealt("anonymous_names", ANONYMOUS, employers.is_anonymous, "anonymous")
dealt("employer_keys", KEYS, employers.company_key, "key")
dealt("industry_of_employer", {"Booking.com B.V.": "Technology", "Expedia Group": "Technology", "Acme": None, "": None}, normalise.industry_of_employer, "industry")
dealt("digest_region", {"Germany": "Europe", "united states": "North America", "UAE": "Middle East", "Multiple countries": "Multiple countries", "Ruritania": "Other countries", "": "Not recorded", "Peru": "Latin America", "Samoa": "Asia-Pacific", "Kenya": "Africa"}, normalise.region, "region")
dealt("script_mismatch", {"Jaguar Land Rover": True, "JLR": True, "捷豹路虎": False, "普利司通 (Bridgestone)": False, "東京": False, "Société": True}, lambda c: reconcile.script_mismatch(c, F.lit("捷豹路虎")), "apart")
dealt("typo_hint", {"acme holdings": False, "bridgestone": False, "bridgestome": True, "bridge stone": False, "brick": False, "bridgeston": True}, lambda c: reconcile.typo_hint(c, F.lit("bridgestone")), "typo")
dealt("bucket_key", {"Meta (Facebook)": "meta", "CTS (Flex)": "cts flex", "Groupe Casino": "casino", "Volkswagen Group": "volkswagen", "SAS": "sas", "Siemens AG": "siemens ag", "Nokia Oyj": "nokia", "Enel S.p.A.": "enel", "Sony (Game Division)": "sony", "Tata Motors Ltd.": "tata motors", "": ""}, reconcile.bucket_key, "key")

dealt("same_employer", {"jaguar land rover": True, "land rover": False, "jlr": False, "tata steel": False, "jaguar": True}, lambda c: employers.same_employer(c, F.when(c == "jaguar land rover", "jlr").when(c == "jaguar", "jaguar cars").when(c == "tata steel", "steel").when(c == "jlr", "jlr").otherwise("rover cars"), c, F.lit("none at all")), "same")
dealt("legal_names", {"Société Générale S.A.": "societe generale", "The Boeing Company": "boeing", "Müller & Co. KG": "muller", "Acme Holdings, Inc.": "acme holdings", "AT&T Inc.": "at and t", "": "", "Nestlé SA": "nestle"}, employers.legal_name, "name")
dealt("dates_anywhere", {"2026-01-22": "2026-01-22", "on 1/22/2026 at noon": "2026-01-22", "Jan 22, 2026": "2026-01-22", "September 3 2025": "2025-09-03", "2026-13-40": None, "1/22/1887": None, "soon": None}, lambda c: text.any_date(c).cast("string"), "day")
dealt("folded_spaces", {"Carl\u202fZeiss  Meditec": "Carl Zeiss Meditec", "\u00a0a\u2003b\u200b": "a b", " x ": "x", "": ""}, text.fold_spaces, "name")
dealt("repaired_xml", {"<rss>a & b</rss>junk": "<rss>a &amp; b</rss>", "<feed>&lt; &#38;</feed>": "<feed>&lt; &#38;</feed>", "R&D": "R&amp;D"}, text.repaired_xml, "xml")

# Texts with a count: {n} stands for the row's own --------------------------------------------------------------------------------------




def counted(name: str, table: dict, kernel, column: str, number: str = "job_count", besides: tuple[str, str] | None = None) -> None:
    """A query that deals sentences with the row's count to the ledger's rows and gives what the kernel says of them.

    ``besides`` is a condition in SQL under which a row's answer is another one, as its count means something else in its sentence.
    """
    values = list(table.values())

    def run(spark, sf_dir):
        n = F.expr(number).cast("long")
        grouped = F.format_number(n, 0)
        sentence = F.replace(F.replace(picked(list(table)), F.lit("{n}"), n.cast("string")), F.lit("{g}"), grouped)
        return facts(spark, sf_dir).select("id", kernel(n, sentence).alias(column))

    other = f"CASE WHEN {besides[0]} THEN {besides[1]} ELSE {pick(values)} END" if besides else pick(values)
    query(name, f"SELECT id, {other} AS {column} FROM ledger")(run)


counted("count_in_excerpt", {"The firm cuts {n} jobs.": True, "It cuts {g} jobs": True, "A bill of $1{n} million": False, "{n}9 people": False, "no number at all": False, "costs {n},000 in all": False, "about {n}.": True}, text.count_in_text, "stated")
counted("headcount_context", {
    "{g} employees will go": True, "a charge of ${g} thousand": False, "reduce the workforce by approximately {g}": True, "will lay off {g} in May": True, "restructuring costs of {g} eliminated": False,
    "revenue rose to {g}": False, "{g} full-time and part-time positions": True, "{g}% of employees": False}, guards.headcount_context, "context")
counted("percent_only", {"{n}% of its staff": True, "{n} percent of staff": True, "{n} jobs": False, "{n}% and {n} jobs": False, "{n}\nPercent of workforce": False, "none": False}, guards.percent_only, "percent", "1 + id % 89")
counted("only_an_offer", {
    "Acme offers voluntary buyouts to {g} employees.": True, "{g} staff are eligible for a buyout": True, "{g} workers accepted buyouts": False, "It will lay off {g} after only 300 accepted buyouts": False,
    "{g} jobs": False, "Acme mulls a buyout for {g} people": True}, guards.only_an_offer, "offer")
counted("disciplinary", {"{g} officers dismissed for misconduct": True, "{g} police sacked in a corruption purge": True, "{g} laid off in a restructuring after misconduct claims": False, "{g} layoffs over budget": False, "{g} jobs": False}, guards.disciplinary, "disciplinary")
counted("held_by_negation", {
    "The outage is not related to {g} job cuts.": True, "Acme denied reports of {g} layoffs.": True, "Acme cut {g} jobs. No layoffs are planned next year.": False, "Acme rules out {g} cuts": True, "Acme cuts {g} jobs": False}, guards.held_by_negation, "held")
counted("jobs_created", {"The plant will create {g} new jobs.": True, "It adds {g} jobs while job cuts hit {g} others.": False, "It will cut {g} jobs.": False, "Hiring {g} new workers. Another site closes.": False, "It hires {g} workers.": True, "nothing": False}, guards.jobs_created, "created")
counted("cost_only", {"restructuring of ${g} this year": True, "costs (2) 11,047 21,336 {g} 53,377": True, "{g} thousand in charges": True, "{g} employees and ${g} in costs": False, "none": False}, guards.cost_only, "cost")
counted("retrospective_verdict", {
    "Amazon has cut around {g} corporate jobs since late 2025.": "retrospective", "Acme cuts {g} jobs.": "event", "It cut 3 more jobs, bringing the total to {g}.": "incremental",
    "Over the past two years it cut {g} roles. It cut {g} jobs on Monday.": "event", "An additional {g} jobs since 2025.": "event", "Its biggest cut since 2020: {g} jobs.": "event",
    "So far this year it shed {g} jobs.": "retrospective", "{g} jobs gone since 2025, it announced on Monday.": "event", "It cut {g} jobs since 2025, and 2024 more.": "retrospective"}, lambda n, t: guards.retrospective(n, t)["verdict"], "verdict", besides=("id % 9 = 8 AND job_count = 2024", "'event'"))
dealt("projection_words", {"could cost 4,500 jobs, a study says": 1, "projected ripple  effects": 2, "Acme cuts 500 jobs": 0, "according to a new report, the county would lose jobs": 2}, lambda c: F.size(guards.projections(c)).cast("int"), "hints")
dealt("filing_section", {"Item 2.05 Costs": "item_2.05", "Item 2.05 x Risk Factors Risks related": "risk_factors", "Risk Factors y Item 5.02 z": "item_5.02", "see the Risk Factors section of our 10-K": None, "": None}, guards.section, "section")
dealt("workforce_percent", {"cut 10% of its workforce": 10.0, "reduce its workforce by approximately 12.5 percent": 12.5, "10% of its revenue": None, "0% of the workforce": None, "": None}, guards.workforce_percent, "pct")
dealt("workforce_estimate", {"cut 10% of its workforce": 123, "reduce our workforce by about 7%": 86, "cuts jobs": None}, lambda c: guards.estimate(c, F.lit(1234)), "jobs")
dealt("reduction_language", {"Acme announces layoffs": "strong", "会社は人 員 削 減を": "strong", "a restructuring plan": "weak", "record profits": "none", "希望退職を募集": "weak", "정리해고 발표": "strong", "": "none"}, guards.reduction_language, "language")
dealt("native_number", {"1.2万人": 12000, "3,500 jobs": 3500, "5千人": 5000, "none": None, "2만 명": 20000}, guards.native_number, "found")
query("filing_lead", """SELECT id, CASE WHEN d IS NULL THEN NULL WHEN d > 365 THEN 'refuse' WHEN d > 120 THEN 'review' ELSE 'ok' END AS verdict FROM (SELECT id, CASE WHEN layoff_date IS NULL AND announcement_date IS NULL THEN NULL
  ELSE greatest(datediff('day', announcement_date, layoff_date), datediff('day', announcement_date, CAST(updated_at AS DATE) + CAST(id % 500 AS INTEGER))) END AS d FROM ledger)""")(
    lambda spark, sf_dir: facts(spark, sf_dir).select("id", guards.lead_verdict(F.col("announcement_date"), F.col("layoff_date"), F.date_add(F.to_date("updated_at"), (F.col("id") % 500).cast("int"))).alias("verdict")))
query("text_window", "SELECT id, substr(excerpt, greatest(1, strpos(excerpt, ' jobs at ') - 6), strpos(excerpt, ' jobs at ') - greatest(1, strpos(excerpt, ' jobs at ') - 6) + 20) AS shown FROM ledger")(
    lambda spark, sf_dir: facts(spark, sf_dir).select("id", guards.text_window(F.col("excerpt"), " jobs at ", 6, 20).alias("shown")))
query("quoted_excerpt", "SELECT id, id % 5 IN (0, 1) AS quoted FROM ledger")(
    lambda spark, sf_dir: facts(spark, sf_dir).select("id", text.quoted(F.element_at(F.array(F.upper("excerpt"), F.replace(F.substring("excerpt", 1, 20), F.lit(" "), F.lit("\n  ")), F.substring("excerpt", 1, 11), F.concat("excerpt", F.lit(" more")), F.lit("Notice of none at all")), (F.col("id") % 5 + 1).cast("int")), F.col("excerpt")).alias("quoted")))
_TRACKED = "CASE page_id % 4 WHEN 0 THEN {0}split_part(url, '?', 1), '?utm_source=x&id=7&Ito=y#top'{1} WHEN 1 THEN {0}url, '/#a'{1} WHEN 2 THEN {0}'HTTPS://', split_part(split_part(url, '?', 1), '://', 2), '?fbclid=1'{1} ELSE url END"
query("url_canonical", ", u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM (SELECT page_id, " + _TRACKED.format("concat(", ")") + r""" AS url FROM pages)),
p AS (SELECT page_id, split_part(url, '?', 1) AS base, list_filter(string_split(split_part(url, '?', 2), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source', 'fbclid', 'ito')) AS q FROM u)
SELECT page_id, regexp_replace(base, '^HTTPS:', 'https:') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p""")(
    lambda spark, sf_dir: read(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.expr(_TRACKED.format("concat(", ")"))).alias("canonical")))
dealt("redirect_targets", {
    "https://news.google.com/rss/articles/x?url=https%3A%2F%2Fpaper.example%2Fa%3Fb%3D1": "https://paper.example/a?b=1", "https://news.google.com/rss/articles/CBMiGmh0dHBzOi8vcGFwZXIuZXhhbXBsZS9hL2IxMtIBAA": "https://paper.example/a/b12",
    "https://news.google.com/rss/articles/AU_yqLNotAUrl": None, "https://news.google.com/x?url=https%3A%2F%2Fwww.google.com%2Fy": None, "https://paper.example/?url=https%3A%2F%2Fother.example%2Fz": None}, text.redirect_target, "target")
dealt("headline_jobs", {"Acme cuts 1,200 jobs": 1200, "Acme lays off 500 of 2,000 workers": 2000, "Acme to cut 12 jobs": None, "Acme cuts 20% of staff": None, "Acme: 300 people go": 300}, text.headline_jobs, "jobs")
dealt("headline_employers", {"Exclusive: Acme cuts 300 jobs": "Acme", "Major Boeing cuts - Paper": "Boeing", "the layoffs go on": "", "IBM's plan": "IBM's", "Top bank cuts": ""}, text.headline_employer, "employer")
dealt("feed_relevance", {"Acme announces layoffs": "term:strong", "A restructuring at Acme": "term:weak", "Acme loses 300 people": "pattern:headcount", "Sports results": "no-layoff-term", "裁员": "language-mismatch", " ": "empty-title"}, text.feed_relevant, "why")
dealt("share_labels", {"0": "0%", "0.4": "under 1%", "1.4": "1%", "99.6": "100%", "": "0%"}, lambda c: text.share_label(c.try_cast("double")), "label")
dealt("change_labels", {"0.061": "+6%", "-0.03": "-3%", "0": "0%"}, lambda c: text.change_label(c.cast("double")), "label")
dealt("names_align", {"zoominfo": True, "zoominfo technologies": True, "zoom": False, "zoominfo technologies inc": True, "": False}, lambda c: employers.names_align(c, F.lit("zoominfo technologies")), "align")
query("strip_html", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+', ' ', 'g')) AS stripped FROM pages""")(
    lambda spark, sf_dir: read(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("stripped")))
query("closed_tags", "SELECT id, array_to_string(list_filter(reason_tags, lambda x: x IN ('closure', 'bankruptcy', 'restructuring')), '|') AS tags FROM ledger")(
    lambda spark, sf_dir: facts(spark, sf_dir).select("id", F.array_join(reconcile.allowed_tags(F.array_append("reason_tags", F.lit("unknown")), ("closure", "bankruptcy", "restructuring", "unknown")), "|").alias("tags")))

# Calendar -------------------------------------------------------------------------------------------------------------------------------

query("release_months", """SELECT id, CASE WHEN day(d) >= CASE WHEN month(d) = 1 AND isodow(f) = 7 THEN 3 WHEN month(d) = 1 AND isodow(f) = 5 THEN 4 WHEN month(d) = 1 AND isodow(f) = 6 THEN 3 WHEN month(d) = 1 THEN 2
    WHEN month(d) = 9 AND isodow(f) IN (1) THEN 2 WHEN month(d) = 9 AND isodow(f) = 7 THEN 3 WHEN month(d) = 9 AND isodow(f) = 6 THEN 4 WHEN isodow(f) = 6 THEN 3 WHEN isodow(f) = 7 THEN 2 ELSE 1 END
  THEN strftime(f - INTERVAL 1 MONTH, '%Y-%m') ELSE strftime(f - INTERVAL 2 MONTH, '%Y-%m') END AS period FROM (SELECT id, layoff_date AS d, date_trunc('month', layoff_date) AS f FROM ledger WHERE layoff_date IS NOT NULL)""")(
    lambda spark, sf_dir: facts(spark, sf_dir).where("layoff_date IS NOT NULL").select("id", normalise.latest_period(F.col("layoff_date")).alias("period")))
query("settled_windows", """SELECT id, CAST(e - INTERVAL 12 MONTH AS DATE) AS first, CAST(e - INTERVAL 1 DAY AS DATE) AS last FROM (SELECT id, date_trunc('month', layoff_date - 45) AS e FROM ledger WHERE layoff_date IS NOT NULL)""")(
    lambda spark, sf_dir: facts(spark, sf_dir).where("layoff_date IS NOT NULL").select("id", normalise.settled_window(F.col("layoff_date")).alias("w")).select("id", "w.first", "w.last"))
query("quarter_windows", """SELECT id, CASE WHEN id % 4 < 3 THEN date_trunc('quarter', layoff_date)::DATE END AS first, CASE WHEN id % 4 < 3 THEN (date_trunc('quarter', layoff_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE END AS last FROM ledger WHERE layoff_date IS NOT NULL""")(
    lambda spark, sf_dir: facts(spark, sf_dir).where("layoff_date IS NOT NULL").select("id", normalise.quarter_window(F.when(F.col("id") % 4 < 3, F.concat(F.year("layoff_date"), F.lit("-Q"), F.quarter("layoff_date"))).otherwise("1997-Q5")).alias("w")).select("id", "w.first", "w.last"))
dealt("instants", {"2026-01-02T03:04:05Z": "2026-01-02 03:04:05", "2026-01-02T03:04:05+02:00": "2026-01-02 01:04:05", "2026-01-02 03:04": "2026-01-02 03:04:00", "yesterday": None, "2026-13-02T00:00:00Z": None, "2026-01-02T23:30:00-05:30": "2026-01-03 05:00:00"},
      lambda c: F.date_format(normalise.instant(c), "yyyy-MM-dd HH:mm:ss"), "at")

# Validation ------------------------------------------------------------------------------------------------------------------------------

#: Source type, text, excerpt, and the decision and reason that must come out.
RECORDS = [
    ("news", "Acme will cut {g} jobs in May.", "", "accept", ""),
    ("news", "Acme denied reports of {g} layoffs.", "", "hold", "negation"),
    ("news", "Acme cuts jobs.", "", "reject", "count not in the text"),
    ("news", "Acme offers voluntary buyouts to {g} employees.", "", "reject", "a voluntary offer"),
    ("news", "{g} officers were dismissed for misconduct.", "", "reject", "dismissed for misconduct"),
    ("news", "The plant will create {g} new jobs.", "", "reject", "jobs created"),
    ("8K", "Restructuring of ${g} was booked.", "Restructuring of ${g} was booked.", "reject", "only a cost"),
    ("8K", "Item 2.05: {g} employees will leave.", "{g} employees will leave", "accept", ""),
    ("8K", "Item 2.05: {g} employees will leave.", "{g} workers are going", "reject", "excerpt not in the text"),
    ("news", "Acme has cut {g} jobs since late 2025.", "", "reject", "cumulative figure"),
]


@query("validated", f"SELECT id, {pick([r[3] for r in RECORDS])} AS decision, {pick([r[4] for r in RECORDS])} AS reason, CASE WHEN {pick([r[3] == 'reject' for r in RECORDS])} THEN NULL ELSE job_count END AS stored_count FROM ledger")
def _(spark, sf_dir):
    rows = facts(spark, sf_dir)
    filled = lambda i: F.replace(picked([r[i] for r in RECORDS]), F.lit("{g}"), F.format_number("job_count", 0))
    rows = rows.withColumns({
        "is_event": F.lit(True), "job_count_max": F.col("job_count"), "employees": F.lit(None).cast("long"), "text": filled(1), "excerpt": filled(2), "source_type": picked([r[0] for r in RECORDS]),
        "section": F.lit(None).cast("string"), "announcement_quote": F.lit(None).cast("string"), "filing_date": F.col("announcement_date"), "ai_quote": F.lit("")})
    return validation.validated(rows, "2000-06-30").select("id", "decision", "reason", "stored_count")


# Scans of tables ----------------------------------------------------------------------------------------------------------------------------


@query("scan_notice_table", """, r AS (SELECT * FROM ledger WHERE source_type = 'warn')
SELECT state, company, CAST(CASE WHEN id % 5 = 0 THEN job_count + 1 ELSE job_count END AS BIGINT) AS job_count, CASE WHEN layoff_date IS NOT NULL AND id % 2 = 0 THEN layoff_date + 11000 ELSE announcement_date + 11000 END AS day FROM (SELECT *, 'IL' AS st FROM r) WHERE job_count > 0""".replace("SELECT state,", "SELECT st AS state,"))
def _(spark, sf_dir):
    """A state's table with its own header: counts in text, a revised column, dates written in two ways, a column that says only True."""
    rows = facts(spark, sf_dir).where("source_type = 'warn'")
    shifted = lambda c: F.date_add(c, 11000)  # noqa: E731  the ledger's years lie before the first plausible one
    table = rows.select(
        F.col("company").alias("Location Name"), F.lit("True").alias("WARN Notice"), F.format_number("job_count", 0).alias("Expected Layoff"), F.when(F.col("id") % 5 == 0, (F.col("job_count") + 1).cast("string")).otherwise("").alias("Revised Layoff"),
        F.lit("12 Main St").alias("Company Address"), F.when(F.col("id") % 2 == 0, F.date_format(shifted("layoff_date"), "M/d/yyyy")).alias("Effective Date"), shifted("announcement_date").cast("string").alias("Notice Date"), F.lit("99").alias("Total Employees"),
    )
    return scans.notices(table, "IL")


@query("agency_months", """, r AS (SELECT strftime(layoff_date, '%Y%m') AS yyyymm, country AS agency, job_count % 7 AS c, id FROM ledger WHERE layoff_date IS NOT NULL AND id % 4 <> 0)
SELECT yyyymm, upper(agency[1]) || lower(agency[2:]) AS agency, CAST(sum(CASE WHEN id % 10 = 0 THEN 1 ELSE c END) AS BIGINT) AS jobs FROM r WHERE yyyymm >= '199601' GROUP BY 1, 2 HAVING sum(CASE WHEN id % 10 = 0 THEN 1 ELSE c END) >= 5""")
def _(spark, sf_dir):
    rows = facts(spark, sf_dir).where("layoff_date IS NOT NULL")
    raw = rows.select(F.date_format("layoff_date", "yyyyMM").alias("yyyymm"), F.concat(F.lit(" "), "country").alias("agency"), F.when(F.col("id") % 4 == 0, "SA").otherwise("SH").alias("category"), F.when(F.col("id") % 10 == 0, "*").otherwise((F.col("job_count") % 7).cast("string")).alias("count"))
    return reports.agency_months(raw, "199601")


query("last_of_week", """, r AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY 1, 2)
SELECT series, max(day) AS day, arg_max(value, day) AS value FROM r WHERE day >= DATE '1990-01-01' GROUP BY series, date_trunc('week', day)""")(
    lambda spark, sf_dir: scans.last_of_week(read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.max("value").alias("value")), "1990-01-01"))
query("legal_entities", """, r AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 18, '0') || '07' AS lei, c_name AS a, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name ELSE 'alias ' || c_custkey END AS b, c_custkey AS k FROM customer)
SELECT DISTINCT lei, CAST(k % 25 AS VARCHAR) AS country, name FROM (SELECT lei, k, a AS name FROM r UNION ALL SELECT lei, k, b FROM r) WHERE name <> '' AND k % 7 <> 0 AND k % 11 <> 0""")(
    lambda spark, sf_dir: scans.legal_entities(read(spark, sf_dir, "customer").select(
        F.concat(F.lpad(F.col("c_custkey").cast("string"), 18, "0"), F.lit("07")).alias("lei"), F.col("c_name").alias("a"), F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(F.concat(F.lit("alias "), "c_custkey")).alias("b"),
        (F.col("c_custkey") % 25).cast("string").alias("country"), F.when(F.col("c_custkey") % 7 == 0, "INACTIVE").otherwise("ACTIVE").alias("entity_status"), F.when(F.col("c_custkey") % 11 == 0, "RETIRED").otherwise("ISSUED").alias("registration_status")), ("a", "b")))
query("posts_to_rows", """SELECT id AS post_id, company AS company_name, CAST(job_count AS VARCHAR) AS job_count, CASE WHEN id % 3 = 0 THEN country END AS country FROM ledger""")(
    lambda spark, sf_dir: scans.posts_to_rows(facts(spark, sf_dir).select(F.col("id").alias("post_id"), F.explode(F.array(
        F.struct((F.col("id") * 10).alias("meta_id"), F.lit("company_name").alias("key"), F.col("company").alias("value")), F.struct((F.col("id") * 10 + 5).alias("meta_id"), F.lit("company_name").alias("key"), F.lit("later").alias("value")),
        F.struct((F.col("id") * 10 + 1).alias("meta_id"), F.lit("job_count").alias("key"), F.col("job_count").cast("string").alias("value")), F.struct((F.col("id") * 10 + 2).alias("meta_id"), F.when(F.col("id") % 3 == 0, "country").otherwise("other").alias("key"), F.col("country").alias("value")))).alias("m")).select("post_id", "m.*"), ("company_name", "job_count", "country")))
