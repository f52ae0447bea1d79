"""Text kernels of ingest: counts, dates, quotes, language guards and addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import fenced, matches, reduction_language

SPACES = r"[\s  -​  　]+"
# Parameters of addresses that only track.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_reader utm_brand utm_social gclid dclid fbclid msclkid twclid igshid mc_cid mc_eid ocid cmpid cmp ito smid smtyp ns_campaign "
    "ns_mchannel ns_source at_medium at_campaign spm _hsenc _hsmi guccounter"
)


def fold_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def fold_quotes(c: Column) -> Column:
    return F.translate(c, "‘’", "''")


def first_number(c: Column) -> Column:
    """The first count in a text; dates and list numbers such as ``1)`` are passed over."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b", " "), r"(^|\s)\d{1,2}\)", " ")
    return F.regexp_replace(F.regexp_extract(bare, r"(\d[\d,]*)", 1), ",", "").try_cast("long")


def any_date(c: Column) -> Column:
    """A date in any of the usual ways of writing, wherever it stands; implausible years are null."""
    months = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
    named = F.regexp_extract(c, rf"(?:{months})\.? \d{{1,2}},? \d{{4}}", 0)
    short = F.concat_ws(" ", F.substring(named, 1, 3), F.regexp_extract(named, r"(\d{1,2}),? \d{4}", 1), F.regexp_extract(named, r"(\d{4})$", 1))
    found = F.coalesce(
        F.try_to_date(F.nullif(F.regexp_extract(c, r"\b\d{4}-\d{2}-\d{2}\b", 0), F.lit("")), "yyyy-MM-dd"),
        F.try_to_date(F.nullif(F.regexp_extract(c, r"\b\d{1,2}/\d{1,2}/\d{4}\b", 0), F.lit("")), "M/d/yyyy"),
        F.try_to_date(F.when(named != "", short), "MMM d yyyy"),
    )
    return F.when(F.year(found) >= 2000, found)


# Words beside a number that make it a count of people, and words before one that make it a year.
HEADCOUNT = "jobs?|employe|workers?|positions?|staff|roles?|layoff|headcount|people|workforce|personnel|hires?|staffers?"
DATE_WORD = "in|by|since|before|after|through|during|fiscal|fy|year|of|the|january|february|march|april|may|june|july|august|september|october|november|december|q[1-4]"


def count_in_text(n: Column, text: Column) -> Column:
    """Whether a text states the count in any way of grouping, not as a part of a longer number.

    A number between 1990 and 2099 that only follows date words and never stands beside a word for people is a year.
    """
    number = fenced(n)
    beside = matches(text, number, rf"\W{{0,4}}(?:{HEADCOUNT})") | matches(text, rf"(?:{HEADCOUNT})\w*\W{{0,6}}(?:of\s+|about\s+|~)?", number)
    year = n.between(1990, 2099) & matches(text, rf"\b(?:{DATE_WORD})\s+", number) & ~beside
    return (n > 0) & matches(text, number) & ~year


def quoted(quote: Column, text: Column) -> Column:
    """Whether a quote of twelve characters or more stands in the text, white space and case aside."""
    q = F.lower(fold_spaces(quote))
    return (F.length(q) >= 12) & F.contains(F.lower(fold_spaces(text)), q)


def strip_html(c: Column) -> Column:
    return fold_spaces(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", " "))


def repaired_xml(c: Column) -> Column:
    """XML with its trailing junk off and its bare ampersands escaped."""
    trimmed = F.regexp_replace(c, r"(?s)(</(?:rss|feed|rdf:RDF)>).*$", "$1")
    return F.regexp_replace(trimmed, r"&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#\d+|#x[0-9a-fA-F]+);)", "&amp;")


def canonical_url(c: Column) -> Column:
    """An address without fragment and tracking parameters; what else it has stays as it is, but for the case of its scheme."""
    bare = F.regexp_replace(F.trim(c), "#.*$", "")
    base, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING.split()))
    scheme = F.regexp_extract(base, r"^(\w+)://", 1)
    plain = F.when(scheme != "", F.concat(F.lower(scheme), F.substring(base, F.length(scheme) + 1, F.length(base)))).otherwise(base)
    return F.concat(plain, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def redirect_target(c: Column) -> Column:
    """The address that a news redirector hides, in a parameter or in its token; null where there is none, or it leads to the redirector's own hosts."""
    own = r"(?i)^https?://(?:[\w-]+\.)*google\.\w+(?:\.\w+)?(?:[/:?#]|$)"
    named = F.url_decode(F.regexp_extract(c, r"[?&](?:url|u)=([^&#]+)", 1))
    token = F.regexp_extract(c, r"/articles/([A-Za-z0-9_-]+)", 1)
    padded = F.rpad(F.translate(token, "-_", "+/"), F.ceil(F.length(token) / 4).cast("int") * 4, F.lit("="))
    blob = F.try_to_binary(padded, F.lit("base64"))
    held = F.regexp_extract(F.decode(blob, "ISO-8859-1"), r"(https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]{6,})", 1)
    good = lambda u: F.when(u.rlike(r"(?i)^https?://[^/:?#]+\.[^/:?#.]+") & ~u.rlike(own), u)
    return F.when(c.rlike(r"(?i)^https?://news\.google\."), F.coalesce(good(named), good(held)))


def share_label(pct: Column) -> Column:
    """A share in whole per cent, with ``under 1%`` for what is less but something; 0% of nothing."""
    return F.when(pct.isNull(), "0%").when((pct > 0) & (pct < 1), "under 1%").otherwise(F.concat(F.round(pct, 0).cast("int"), F.lit("%")))


def change_label(change: Column) -> Column:
    """A change in whole per cent with its sign."""
    pct = F.round(change * 100, 0).cast("int")
    return F.concat(F.when(pct > 0, "+").otherwise(""), pct.cast("string"), F.lit("%"))


# How headlines state a count, and words that open one without naming an employer.
HEADLINE_COUNT = r"(?i)\b(\d{1,3}(?:,\d{3})+|\d{2,6})\s+(?:\w+\s+){0,2}(?:jobs?|employees|workers|staff|positions|roles|people)\b(?!\s*%)"
HEADLINE_STOP = "major top global local state federal national leading giant embattled struggling troubled the a an report breaking exclusive update"


def headline_jobs(title: Column, least: int = 50) -> Column:
    """The first count of people that a headline states, if it is not too small."""
    n = F.regexp_replace(F.regexp_extract(title, HEADLINE_COUNT, 1), ",", "").try_cast("long")
    return F.when(n >= least, n)


def headline_employer(title: Column) -> Column:
    """The word that names a headline's employer, as far as one can tell: the first in capitals before any other, or blank."""
    t = F.regexp_replace(F.trim(F.regexp_replace(title, r"\s+", " ")), r"^[A-Z][A-Za-z]{2,9}:\s*", "")
    words = F.filter(F.split(F.regexp_replace(t, r"\s+[-–|]\s+.*$", ""), r"[^A-Za-z0-9&.'’-]+"), lambda w: (w != "") & ~F.array_contains(F.array(*map(F.lit, HEADLINE_STOP.split())), F.lower(w)))
    first = F.btrim(F.get(words, 0), F.lit(".'’-"))
    return F.when(first.rlike("^[A-Z]") & (F.length(first) >= 3), first).otherwise("")


def feed_relevant(title: Column, english: bool = True) -> Column:
    """Why a headline is kept or not: its language first, then words for reductions, then a stated count."""
    blank = F.trim(F.coalesce(title, F.lit(""))) == ""
    out = F.when(blank, "empty-title")
    if english:
        out = out.when(F.coalesce(latin_share(title), F.lit(0.0)) < 0.8, "language-mismatch")
    kind = reduction_language(title)
    return out.when(kind != "none", F.concat(F.lit("term:"), kind)).when(headline_jobs(title).isNotNull(), "pattern:headcount").otherwise("no-layoff-term")


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^\w+://([^/:?#]+)", 1)), r"^www\.", "")


def latin_share(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(r"\p{IsLatin}")) / letters)


def boundary_pattern(term: str) -> str:
    """A word-boundary pattern for a Latin search term, empty for terms in other scripts."""
    import regex

    term = term.strip()
    if not regex.fullmatch(r"[\p{Latin}\p{Nd}\p{P}\p{S}\p{Zs}\s]+", term) or not regex.search(r"[\p{L}\p{Nd}]", term):
        return ""
    return ("\\b" if regex.match(r"[\p{L}\p{Nd}_]", term) else "") + re.escape(term) + ("\\b" if regex.search(r"[\p{L}\p{Nd}_]$", term) else "")


def formula_guard(c: Column) -> Column:
    """A leading quote before what a spreadsheet would run."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
