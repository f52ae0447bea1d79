"""The filter algebra all views share: one specification, compiled to a Column.

Dimensions are joined by AND, the values of one dimension by OR. ``without`` drops one dimension, so that a facet keeps showing
all of its own values. Unknown names raise; dates that are no dates are ignored, as are values out of range.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import boundary_pattern, fold_quotes

OFFICIAL = ("8K", "warn", "federal_rif", "filing")
TERM_LIMIT = 200


@dataclass(frozen=True)
class FilterSpec:
    date_basis: str = "effective"
    date_from: str | None = None
    date_to: str | None = None
    years: tuple[int, ...] = ()
    quarters: tuple[int, ...] = ()
    months: tuple[int, ...] = ()
    industry: tuple[str, ...] = ()
    state: tuple[str, ...] = ()
    country: tuple[str, ...] = ()
    country_basis: str = "strict"
    employer_country: tuple[str, ...] = ()
    reasons: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    tier: tuple[str, ...] = ()
    ai: bool = False
    ai_primary: bool = False
    ai_broad: bool = False
    review_status: str | None = None
    context_missing: bool = False
    roles_missing: bool = False
    industry_missing: bool = False
    stage: str | None = None
    company: str | None = None
    keyword: str | None = None
    q: str | None = None
    company_key: tuple[str, ...] = ()
    sourced: bool = False
    exclude_supersets: bool = False
    min_jobs: int | None = None
    exclude_id: int | None = None

    @classmethod
    def of(cls, **named) -> FilterSpec:
        """A specification from request-like parameters; single values may stand for tuples."""
        known = {f.name: f for f in fields(cls)}
        if unknown := set(named) - set(known):
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        tuples = {n for n, f in known.items() if str(f.type).startswith("tuple")}
        return cls(**{k: (v,) if k in tuples and not isinstance(v, tuple | list) else tuple(v) if k in tuples else v for k, v in named.items()})

    def without(self, dimension: str) -> FilterSpec:
        return replace(self, **{dimension: next(f.default for f in fields(self) if f.name == dimension)})


def basis(name: str = "effective") -> Column:
    """The date that filters and buckets both use."""
    columns = {"effective": F.col("layoff_date"), "announcement": F.col("announcement_date"), "notice": F.coalesce("announcement_date", "layoff_date")}
    return columns[name]


def tier() -> Column:
    return F.when(F.col("source_type").isin(*OFFICIAL) & (F.col("verification_level") != "bronze"), "verified").otherwise("reported")


def among(column: str, values: tuple[str, ...]) -> Column:
    """Membership without regard to case."""
    return F.lower(column).isin(*[v.lower() for v in values])


def in_country(values: tuple[str, ...], how: str) -> Column:
    place, home = among("country", values), among("employer_country", values)
    if how == "employer":
        return F.when(F.col("employer_country") != "", home).otherwise(place)
    return place | home if how == "any" else place


def free_text(columns: tuple[str, ...], term: str) -> Column:
    """Columns that contain the term and, for Latin terms, hold it as a word. Apostrophes are folded where the term has one."""
    term = term[:TERM_LIMIT]
    fold = any(c in term for c in "'‘’")
    term = term.replace("‘", "'").replace("’", "'") if fold else term
    held = [F.lower(fold_quotes(F.col(c)) if fold else F.col(c)) for c in columns]
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    out = any_of([F.contains(c, F.lit(term.lower())) for c in held])
    pattern = boundary_pattern(term.lower())
    return out & any_of([c.rlike(pattern) for c in held]) if pattern else out


def compile_dimensions(spec: FilterSpec) -> dict[str, Column]:
    """The row-wise tests of ``spec`` by dimension, for those that it names; ``sourced`` needs other tables and is applied by ``apply_filters``."""
    day = basis(spec.date_basis)
    tests: dict[str, list[Column]] = {}
    add = lambda name, test: tests.setdefault(name, []).append(test)
    valid = lambda d: d is not None and re.fullmatch(r"\d{4}-\d{2}-\d{2}", d)
    if valid(spec.date_from):
        add("date_from", day >= F.to_date(F.lit(spec.date_from)))
    if valid(spec.date_to):
        add("date_to", day <= F.to_date(F.lit(spec.date_to)))
    for name, part, low, high in (("years", F.year, 1990, 2100), ("quarters", F.quarter, 1, 4), ("months", F.month, 1, 12)):
        if values := getattr(spec, name):
            add(name, day.isNotNull() & part(day).isin(*[v for v in values if low <= v <= high]))
    for column in ("industry", "state", "employer_country"):
        if values := getattr(spec, column):
            add(column, among(column, values))
    if spec.country:
        add("country", in_country(spec.country, spec.country_basis))
    if spec.reasons:
        add("reasons", F.arrays_overlap("reason_tags", F.array(*map(F.lit, spec.reasons))))
    if roles := [r for r in spec.roles if r != "unknown"]:
        add("roles", F.arrays_overlap("role_categories", F.array(*map(F.lit, roles))))
    if spec.sources:
        add("sources", among("verification_level", spec.sources) | among("source_type", spec.sources))
    if spec.tier:
        add("tier", tier().isin(*spec.tier))
    if spec.ai:
        add("ai", F.col("ai_explicit"))
    if spec.ai_primary:
        add("ai_primary", F.col("ai_causation") == "primary_cause")
    if spec.ai_broad:
        add("ai_broad", F.col("ai_explicit") | (F.col("ai_causation") == "ai_linked"))
    if spec.review_status:
        add("review_status", F.col("review_status") == spec.review_status)
    if spec.context_missing:
        add("context_missing", F.size("reason_tags") == 0)
    if spec.roles_missing:
        add("roles_missing", (F.size("role_categories") == 0) & ~F.col("source_type").isin("warn", "erm") & (F.col("excerpt") != ""))
    if spec.industry_missing:
        add("industry_missing", F.col("industry") == "")
    if spec.stage in ("announced", "verified"):
        add("stage", F.col("announced") == F.lit(spec.stage == "announced"))
    for name, columns in (("company", ("company",)), ("keyword", ("company", "excerpt")), ("q", ("company", "excerpt", "industry", "country", "source_name"))):
        if term := getattr(spec, name):
            add(name, free_text(columns, term))
    if spec.company_key:
        add("company_key", F.col("company_key").isin(*spec.company_key))
    if spec.exclude_supersets:
        add("exclude_supersets", F.col("superset_of") == 0)
    if spec.min_jobs is not None:
        add("min_jobs", F.col("job_count") >= spec.min_jobs)
    if spec.exclude_id is not None:
        add("exclude_id", F.col("id") != spec.exclude_id)
    return {name: reduce(lambda a, b: a & b, own) for name, own in tests.items()}


def compile_filters(spec: FilterSpec) -> Column:
    """All row-wise dimensions of ``spec`` in one test."""
    return reduce(lambda a, b: a & b, compile_dimensions(spec).values(), F.lit(True))


def apply_filters(facts: DataFrame, spec: FilterSpec, events: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    out = facts.where(compile_filters(spec))
    if spec.sourced:
        canonical = events.select("event_id", F.col("canonical_id").alias("id"))
        linked = reports.where("source_url <> ''").select("event_id")
        out = out.join(canonical, ["event_id", "id"], "left_semi").join(linked, "event_id", "left_semi")
    return out
