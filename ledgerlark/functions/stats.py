"""Small statistics as column arithmetic. What can't be measured is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959964


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval; null for an empty sample."""
    p, zz = hits / n, z * z
    middle, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = (middle - half) / (1 + zz / n), (middle + half) / (1 + zz / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))), F.when(n > 0, F.least(high, F.lit(1.0)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(100 * part / whole, digits))


def direction(change: Column, threshold: float = 0.05) -> Column:
    return F.when(change >= threshold, "up").when(change <= -threshold, "down").when(change.isNotNull(), "flat")


def vote(up: Column, down: Column, judged: Column) -> Column:
    """Status of several judged series; null with fewer than two."""
    return F.when(judged < 2, None).when((up >= 2) & (up > down), "heating").when((down >= 2) & (down > up), "cooling").otherwise("stable")


def dark_verdict(days_dark: Column, per_year: Column, cadence: Column) -> Column:
    """Whether a source that has been silent for so many days is out of its own habit."""
    p0 = F.exp(-per_year / 365 * days_dark)
    return (
        F.when(days_dark.isNull() | per_year.isNull() | cadence.isNull(), "UNKNOWN")
        .when(days_dark < 14, "PASS").when(p0 >= 0.05, "PASS").when(days_dark <= 1.25 * cadence, "PASS").when(p0 >= 0.01, "QUIET").otherwise("FAIL")
    )
