"""Normalisers of ingest: countries, industries, roles, states, regions, notice names, calendar and instants.

Every rule is a column expression; ordered rules are one chain of conditions. Null counts as blank.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# Vocabularies that results must agree with.
AND_COUNTRIES = {
    "trinidad and tobago": "Trinidad and Tobago", "bosnia and herzegovina": "Bosnia and Herzegovina", "antigua and barbuda": "Antigua and Barbuda",
    "saint kitts and nevis": "Saint Kitts and Nevis", "st kitts and nevis": "Saint Kitts and Nevis", "saint vincent and the grenadines": "Saint Vincent and the Grenadines",
    "sao tome and principe": "Sao Tome and Principe", "turks and caicos islands": "Turks and Caicos Islands", "turks and caicos": "Turks and Caicos Islands",
}
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC", "washington dc": "DC",
}
PROVINCES = (
    "alberta", "british columbia", "manitoba", "new brunswick", "newfoundland and labrador", "northwest territories", "nova scotia", "nunavut", "ontario", "prince edward island",
    "quebec", "saskatchewan", "yukon",
)
COUNTRY_NAMES = {
    "us": "United States", "usa": "United States", "united states": "United States", "united states of america": "United States", "america": "United States", "u s": "United States",
    "u s a": "United States", "uk": "United Kingdom", "united kingdom": "United Kingdom", "britain": "United Kingdom", "great britain": "United Kingdom", "england": "United Kingdom",
    "uae": "UAE", "united arab emirates": "UAE", "deutschland": "Germany", "china": "China", "peoples republic of china": "China", "prc": "China", "mainland china": "China",
    "korea": "South Korea", "south korea": "South Korea", "republic of korea": "South Korea", "turkey": "Türkiye", "trkiye": "Türkiye", "turkiye": "Türkiye",
    "republic of turkiye": "Türkiye", "republic of trkiye": "Türkiye",
}
SEVERAL = "Multiple countries"
SEVERAL_NAMES = "global worldwide international europe|north america|south america|latin america|asia|asia pacific|apac emea multiple|multiple countries|various"
INDUSTRY_OF_EMPLOYER = {"booking.com": "Technology", "bookings.com": "Technology", "expedia": "Technology", "airbnb": "Technology", "tripadvisor": "Technology"}
INDUSTRY_EXACT = {"it": "Technology", "ai": "Technology", "ml": "Technology"}
INDUSTRY_RULES = {
    "Healthcare & Pharma": "pharma|biotech|bio-tech|health|medical|genomic|dermatolog|biopharma|life science|regenerative",
    "Finance & Insurance": "bank|fintech|fin-tech|insurtech|financ|insurance|investment|crypto|payments|lending|mortgage",
    "Education": "education|university|school|edtech|ed-tech|learning",
    "Aerospace & Defense": "aerospace|defense|aviation product",
    "Airlines & Travel": "airline|air travel|travel|cruise",
    "Automotive": "automotive|auto|electric vehicle|ev|used car|car marketplace|car dealer",
    "Technology": "artificial intelligence|ai/|robotic|software|cloud|cyber|saas|semiconductor|chip|information technology|tech|internet|computing|data center|it services",
    "Telecom": "telecom|broadband|connectivity|wireless",
    "Media & Entertainment": "media|broadcast|radio|news|entertainment|gaming|game|streaming|publishing|film|arts|sports",
    "Retail & E-commerce": "retail|e-commerce|ecommerce|grocery|apparel|fashion",
    "Food & Hospitality": "hospitality|hotel|restaurant|food|beverage",
    "Energy": "energy|oil|gas|coal|solar|nuclear|renewable|utilit|electric|mining|quarry|water|waste",
    "Logistics & Transport": "logistic|transport|trucking|shipping|freight|rail|delivery|supply chain",
    "Real Estate & Construction": "real estate|construction|reit|housing|property",
    "Manufacturing": "manufactur|industrial|paper|containerboard|steel|chemical|machinery|production",
    "Consumer Goods": "consumer|cannabis|cbd|household|cosmetic|toy",
    "Professional Services": "consult|professional|legal|accounting|staffing|recruit|hr|scientific and technical|administrative|adminstrative|support services|other services",
    "Agriculture": "agricultur|farm",
    "Government & Nonprofit": "government|public sector|public administr|defence|nonprofit|non-profit",
}
ROLE_RULES = {
    "engineering": "engineer|developer|software|programmer|devops|data scientist|machine learning|infrastructure|information technology|it staff|it department|it workers|technical staff|quality assurance|qa|it",
    "product_design": "product manag|product team|product and design|product, design|designer|design team|ux|ui",
    "customer_support": "customer support|customer service|customer success|customer care|customer experience|call center|call centre|contact center|contact centre|help desk|helpdesk|support team|support staff|support agent",
    "sales_marketing": "sales|marketing|advertis|business development|account manag|commercial team|go-to-market",
    "hr_recruiting": "human resources|recruit|talent acquisition|people team|hr",
    "operations_warehouse": "operations|warehouse|logistics|fulfillment|fulfilment|driver|delivery|supply chain|distribution|dispatch",
    "content_trust_safety": "trust and safety|trust & safety|content moderat|moderation|content review|content team|editorial|journalist|newsroom|writer|curation",
    "finance_admin": "finance|accounting|accountant|administrative|back office|back-office|payroll|legal|compliance|admin",
    "manufacturing": "manufactur|production worker|production staff|production line|assembly|factory|plant worker|machinist|fabrication",
    "retail_staff": "retail|store associate|store employee|store staff|store worker|cashier|shop floor|sales floor",
}


def several_names() -> list[str]:
    return [n for part in SEVERAL_NAMES.split("|") for n in ([part] if part in ("north america", "south america", "latin america", "asia pacific", "multiple countries") else part.split(" "))]


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key in a small fixed table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def country(name: Column) -> Column:
    """One name per country; states and provinces fold into theirs, regions and lists are several countries, unknown names stay."""
    raw = blank(name)
    places = [s for s in STATES if s not in ("georgia", "washington dc")]

    def named(key: Column) -> Column:
        suffix = F.regexp_extract(key, "^united states(?: of america)? (.+)$", 1)
        of_union = suffix.isin(*STATES, *[c.lower() for c in STATES.values()]) & (suffix != "washington dc")
        listed = raw.rlike(r"(?i)[,/&+]|\bplus\b") | key.rlike(r"\band\b")
        return F.coalesce(
            lookup(AND_COUNTRIES, key), F.when(key.isin(*places) | of_union, "United States"), F.when(key.isin(*PROVINCES), "Canada"), lookup(COUNTRY_NAMES, key),
            F.when(key.isin(*several_names()), SEVERAL), F.when(listed, SEVERAL), raw,
        )

    return let(F.trim(F.regexp_replace(F.lower(F.regexp_replace(raw, "[^A-Za-z\\s]", "")), "\\s+", " ")), named)


def keyword_pattern(keywords: str) -> str:
    """One pattern for a list of keywords: those of up to four letters match whole words only."""
    return "|".join(rf"\b{re.escape(k)}\b" if len(k) <= 4 else re.escape(k) for k in keywords.split("|"))


def industry(value: Column) -> Column:
    """The first rule whose keyword is in the text, or the text in title case."""

    def ruled(key: Column) -> Column:
        out = F.when(key == "", "").when(key.isin(*INDUSTRY_EXACT), lookup(INDUSTRY_EXACT, key))
        for label, keywords in INDUSTRY_RULES.items():
            out = out.when(key.rlike(keyword_pattern(keywords)), label)
        return out.otherwise(F.initcap(key))

    return let(F.lower(blank(value)), ruled)


def industry_of_employer(company: Column) -> Column:
    """Industries of a few employers that sources disagree about, or null."""
    low = F.lower(F.coalesce(company, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), v) for k, v in INDUSTRY_OF_EMPLOYER.items()])


def roles(value: Column) -> Column:
    """Every role category that a text names, in the fixed order."""
    key = F.regexp_replace(F.lower(blank(value)), "people operations|people ops", "human resources")
    return F.array_compact(F.array(*[F.when(key.rlike(keyword_pattern(words)), slug) for slug, words in ROLE_RULES.items()]))


def state(value: Column) -> Column:
    """The two-letter code of a US state given as code or name, or blank."""
    raw = blank(value)
    code = F.regexp_replace(F.upper(raw), "[^A-Z]", "")
    name = F.trim(F.regexp_replace(F.translate(F.lower(raw), ".", ""), "\\s+", " "))
    return F.when(code.isin(*STATES.values()), code).otherwise(F.coalesce(lookup(STATES, name), F.lit("")))


# Markup and commentary that notice tables put into employer names.
RESCINDED = r"(?i)\b(rescind\w*|cancell?ed)\b"
UPDATE_LEAD = r"(?i)^(?:\s*update\s*:\s*)+"
BARE_UPDATE = r"(?i)^\s*update\s+(?=\S.*\b(?:inc|llc|l\.l\.c|ltd|corp|corporation|co|company|lp|l\.p|plc)\b\.?)"
STREET = (
    r"(?i)[\s(,]+\d{1,6}(?:\s*-\s*\d{1,6})?\s+[\w.'-]+(?:\s+[\w.'-]+){0,3}\s+"
    r"(?:st|street|rd|road|ave|avenue|hwy|highway|blvd|boulevard|dr|drive|ln|lane|pkwy|parkway|way|ct|court|cir|circle|pl|place|ter|terrace|route|rte)\b\.?"
)
CITY_LINE = r"[\s,(]+[A-Za-z .'-]+,\s*[A-Z]{2},?\s*\d{5}(?:-\d{4})?\b"
SITE_MARK = r"(?i)[\s,]*\b(?:no\.?|#|unit|suite|ste\.?)\s*$"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def notice_name(name: Column) -> Column:
    """An employer's name as a notice table gives it, without tags, entities, footnotes, update marks and site address; null if the notice is rescinded."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), "<[^>]*>", " ")
    out = bare
    for entity, letter in ENTITIES.items():
        out = F.regexp_replace(out, entity, letter)
    for pattern in (UPDATE_LEAD, BARE_UPDATE, r"(?s)\s*\*.*$"):
        out = F.regexp_replace(out, pattern, "")
    edge = " ,;-"

    def without_address(pattern: str):
        found = f"(?i)^(.*?)(?:{pattern[4:]})" if pattern.startswith("(?i)") else f"^(.*?)(?:{pattern})"

        def cut(name: Column) -> Column:
            # Only what is left before the address can be a name.
            return let(F.btrim(F.regexp_extract(name, found, 1), F.lit(edge + "([")), lambda head: F.when((F.length(head) >= 3) & head.rlike("[A-Za-z]{3}"), head).otherwise(name))

        return cut

    out = F.btrim(F.regexp_replace(out, "\\s+", " "), F.lit(edge))
    for pattern in (STREET, CITY_LINE):
        out = let(out, without_address(pattern))
    return F.when(~bare.rlike(RESCINDED), F.btrim(F.regexp_replace(F.btrim(out, F.lit(edge)), SITE_MARK, ""), F.lit(edge)))


# The regions of a digest, with the countries in them.
REGIONS = {
    "North America": "United States|USA|US|Canada|Greenland|Bermuda",
    "Europe": "United Kingdom|UK|Guernsey|Isle of Man|Jersey|Albania|Austria|Belgium|Bosnia and Herzegovina|Bulgaria|Croatia|Cyprus|Czechia|Czech Republic|Denmark|Estonia|Finland|France|"
    "Germany|Greece|Hungary|Iceland|Ireland|Italy|Latvia|Liechtenstein|Lithuania|Luxembourg|Malta|Moldova|Monaco|Montenegro|Netherlands|North Macedonia|Norway|Poland|Portugal|Romania|"
    "Serbia|Slovakia|Slovenia|Spain|Sweden|Switzerland|Ukraine|Russia|Russian Federation|Belarus|Armenia|Azerbaijan",
    "Middle East": "Bahrain|Iran|Iraq|Israel|Jordan|Kuwait|Lebanon|Oman|Qatar|Saudi Arabia|Türkiye|Turkey|United Arab Emirates|UAE|Palestine",
    "Asia-Pacific": "Australia|Bangladesh|Cambodia|China|People's Republic of China|Hong Kong|India|Indonesia|Japan|Korea|South Korea|Laos|Macau|Malaysia|Mongolia|Myanmar|Nepal|New Zealand|"
    "Pakistan|Philippines|Singapore|Sri Lanka|Taiwan|Thailand|Vietnam|Kazakhstan|Uzbekistan|Afghanistan|Samoa",
    "Latin America": "Mexico|Argentina|Bolivia|Brazil|Chile|Colombia|Costa Rica|Dominican Republic|Ecuador|El Salvador|Guatemala|Honduras|Nicaragua|Panama|Paraguay|Peru|Puerto Rico|"
    "Uruguay|Venezuela|Bahamas|Jamaica",
    "Africa": "Algeria|Botswana|Egypt|Ethiopia|Ghana|Kenya|Morocco|Nigeria|Rwanda|Senegal|South Africa|Tanzania|Tunisia|Uganda|Zambia|Zimbabwe|Malawi|Mauritius",
}


def region(name: Column, regions: dict[str, str] | None = None) -> Column:
    """The region of a country; several countries, countries of no region and blanks have rows of their own."""
    of = {c.lower(): r for r, names in (regions or REGIONS).items() for c in names.split("|")}
    key = F.lower(blank(name))
    return F.coalesce(lookup(of, key), F.when(key == SEVERAL.lower(), SEVERAL), F.when(key == "", "Not recorded"), F.lit("Other countries"))


def first_business_day(month: Column) -> Column:
    """First day of a month's first seven that is no weekend, New Year's Day (or its Monday) or Labor Day."""
    first = F.trunc(month, "month")
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add(first, i))

    def works(d: Column) -> Column:
        weekday, m, n = F.weekday(d), F.month(d), F.dayofmonth(d)  # Monday is 0
        holiday = ((m == 1) & ((n == 1) | ((n == 2) & (weekday == 0)))) | ((m == 9) & (weekday == 0))
        return (weekday < 5) & ~holiday

    return F.element_at(F.filter(days, works), 1)


def latest_period(today: Column) -> Column:
    """The newest month whose report is out: last month from the first business day on, the one before until then."""
    back = F.when(today >= first_business_day(today), -1).otherwise(-2)
    return F.date_format(F.add_months(F.trunc(today, "month"), back), "yyyy-MM")


def quarter_window(name: Column) -> Column:
    """First and last day of a quarter such as ``1997-Q2``; null for anything else."""
    year, q = F.regexp_extract(name, r"^(\d{4})-Q([1-4])$", 1).try_cast("int"), F.regexp_extract(name, r"^(\d{4})-Q([1-4])$", 2).try_cast("int")
    first = F.make_date(year, q * 3 - 2, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first.alias("first"), F.last_day(F.add_months(first, 2)).alias("last")))


def settled_window(today: Column, settle: int = 45) -> Column:
    """The twelve whole months that end before what may still change."""
    last = F.date_sub(F.trunc(F.date_sub(today, settle), "month"), 1)
    return F.struct(F.add_months(F.date_add(last, 1), -12).alias("first"), last.alias("last"))


def instant(text: Column) -> Column:
    """An ISO instant with zone or ``Z``, or a plain one in UTC, as a time without zone in UTC; null if it is none."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
    full = F.regexp_replace(text, r"^(.{16})(Z|[+-]|$)", "$1:00$2")
    zoned = F.when(full.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(ok, F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.try_cast("timestamp").cast("timestamp_ntz")))
