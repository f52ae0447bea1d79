"""The ordered checks between an extracted record and a stored entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from ..functions.normalise import state
from ..functions.text import fold_spaces, quoted
from ..sources.ledger import AI_CAUSES, REASON_TAGS

FIRST_DAY = "2015-01-01"


def validated(rows: DataFrame, today: str) -> DataFrame:
    """``rows`` with ``decision`` (accept, hold, reject), ``reason`` and the values as they would be stored.

    Columns read: is_event, company, job_count, job_count_max, employees, text, excerpt, source_type, section, layoff_date,
    announcement_date, announcement_quote, filing_date, reason_tags, ai_causation, ai_quote, announced, confidence, state,
    country, verification_level. The first check that fails gives the reason; nulls fail as blanks do.
    """
    n, text = F.col("job_count"), F.coalesce("text", F.lit(""))
    shared = n.isNull() | (n <= 0) | guards.percent_only(n, text)
    guess = F.when(shared & F.col("source_type").isin("8K", "news") & ~F.coalesce(F.col("section") == "risk_factors", F.lit(False)), guards.estimate(text, F.col("employees")))
    estimated = F.coalesce(guess > 0, F.lit(False))
    rows = rows.withColumns({"_estimated": estimated, "_count": F.when(estimated, guess).otherwise(n), "_verdict": guards.retrospective(n, text)})
    own, filing, plain = F.col("_count"), F.col("source_type") == "8K", ~F.col("_estimated")
    lead = guards.lead_verdict(F.when(quoted(F.col("announcement_quote"), text), F.col("announcement_date")), F.col("layoff_date"), F.col("filing_date"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    reject = F.coalesce(
        F.when(no(F.col("is_event")), "not an event"),
        F.when(own.isNull() | (own <= 0), "no count"),
        F.when(plain & guards.percent_only(n, text), "only a percentage"),
        F.when(plain & no(guards.matches(text, guards.fenced(own))), "count not in the text"),
        F.when(plain & yes(guards.only_an_offer(own, text)), "a voluntary offer"),
        F.when(plain & yes(guards.disciplinary(own, text)), "dismissed for misconduct"),
        F.when(plain & yes(guards.jobs_created(own, text)), "jobs created"),
        F.when(plain & filing & yes(F.col("section") == "risk_factors"), "risk factors"),
        F.when(plain & filing & yes(guards.cost_only(own, text)), "only a cost"),
        F.when(plain & filing & no(quoted(F.col("excerpt"), text)), "excerpt not in the text"),
        F.when(plain & filing & no(guards.headcount_context(own, F.col("excerpt"))), "no headcount context"),
        F.when(plain & (F.col("_verdict.verdict") == "retrospective"), "cumulative figure"),
        F.when(fold_spaces(F.coalesce("company", F.lit(""))) == "", "no employer"),
        F.when(filing & yes(lead == "refuse"), "announced too long ago"),
        F.when(F.coalesce(F.when(F.col("_verdict.verdict") == "incremental", F.col("_verdict.figure")), own) > guards.CAP, "implausible count"),
    )
    hold = F.when(plain & yes(guards.held_by_negation(own, text)), "negation")
    count = F.when(plain & (F.col("_verdict.verdict") == "incremental"), F.col("_verdict.figure")).otherwise(own)
    highest = F.when((F.col("job_count_max") >= count) & (F.col("_verdict.verdict") != "incremental") & guards.matches(text, guards.fenced(F.col("job_count_max"))), F.col("job_count_max")).otherwise(count)
    last = F.date_add(F.to_date(F.lit(today)), 3 * 366)
    inside = lambda d: F.when((d >= F.lit(FIRST_DAY).cast("date")) & (d <= last), d)
    day = F.coalesce(inside(F.coalesce("layoff_date", "filing_date")), inside(F.col("filing_date")))
    cited = yes(quoted(F.col("ai_quote"), text))
    cause = F.when(~F.col("ai_causation").isin(*AI_CAUSES) | F.col("ai_causation").isNull(), "unknown").when(F.col("ai_causation").isin("primary_cause", "contributing_cause") & ~cited, "unknown").otherwise(F.col("ai_causation"))
    sure = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("confidence", F.lit(0))))
    sure = F.when(sure > 0, sure).when(F.col("verification_level").isin("gold", "silver"), 85).otherwise(65)
    place = state(F.col("state"))
    return rows.withColumns({
        "decision": F.when(reject.isNotNull(), "reject").when(hold.isNotNull(), "hold").otherwise("accept"), "reason": F.coalesce(reject, hold, F.lit("")),
        "stored_count": F.when(reject.isNull(), count), "stored_max": F.when(reject.isNull(), highest), "stored_day": day,
        "stored_causation": cause, "stored_explicit": cause.isin("primary_cause", "contributing_cause"), "stored_announced": yes(F.col("announced")) & (F.col("source_type") == "news"),
        "stored_confidence": F.when(F.col("_estimated"), F.least(sure, F.lit(60))).otherwise(sure), "stored_tags": F.array_intersect("reason_tags", F.array(*map(F.lit, REASON_TAGS))),
        "stored_state": place, "stored_country": F.when((place != "") & (F.coalesce(F.trim("country"), F.lit("")) == ""), "United States").otherwise(F.coalesce("country", F.lit(""))),
        "review": F.when(F.col("_estimated"), "provisional").when(filing & yes(lead == "review"), "adjudicate").otherwise(""),
    }).drop("_estimated", "_count", "_verdict")
