"""Sinks: guarded CSV, JSON lines, long appendix, compressed backups and append-only telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import formula_guard

EXPORTED = ("id", "company", "ticker", "job_count", "layoff_date", "announcement_date", "industry", "country", "state", "source_type", "verification_level", "source_name", "source_url", "ai_causation", "excerpt")


def export_rows(facts: DataFrame) -> DataFrame:
    """Rows for a spreadsheet: every text guarded against formulas, tags joined, unknown roles left out."""
    texts = {n for n, t in facts.dtypes if t == "string"}
    columns = [formula_guard(F.col(c)).alias(c) if c in texts else F.col(c) for c in EXPORTED]
    return facts.select(*columns, F.array_join("reason_tags", "|").alias("reasons"), F.array_join(F.array_remove("role_categories", "unknown"), "|").alias("roles"))


def write_csv(facts: DataFrame, path: str) -> None:
    export_rows(facts).write.option("header", True).option("escape", '"').csv(path)


def json_lines(facts: DataFrame, filters: str) -> DataFrame:
    """(place, line): an envelope line with the filters and the number of rows, then one line per row; the rows are never gathered."""
    rows = facts.select(F.col("id").alias("place"), F.to_json(F.struct("id", "company", "job_count", "country")).alias("line"))
    head = facts.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(0).cast("long").alias("place"), F.to_json(F.struct(F.lit(filters).alias("filters"), "rows")).alias("line"))
    return head.unionByName(rows)


def appendix(parts: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Aggregates side by side in long form: section, label, metric, value."""
    out = None
    for section, df in parts.items():
        numbers = [c for c, t in df.dtypes if c != label and t in ("bigint", "int")]
        long = df.select(label, *[F.col(c).cast("long").alias(c) for c in numbers]).unpivot([label], numbers, "metric", "value")
        long = long.select(F.lit(section).alias("section"), F.col(label).alias("label"), "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


# What must not be in a public backup.
PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\+?\d{1,3}[ .-]\(?\d{2,4}\)?[ .-]\d{3}[ .-]\d{3,4}"}


def personal_data(df: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, rows): how many rows have an address or number of a person in one of the columns."""
    text = F.concat_ws(" ", *columns)
    counts = df.agg(*[F.count(F.when(text.rlike(p), 1)).alias(k) for k, p in PERSONAL.items()])
    return counts.unpivot([], list(PERSONAL), "kind", "rows")


def backup(df: DataFrame, path: str, columns: list[str], last_rows: int | None = None, tolerance: float = 0.05) -> int:
    """Compressed JSON lines with pinned columns; returns the rows written, after holding them against the rows read back.

    Raises, and writes nothing, where personal data stand in the columns or rows are gone against the last backup beyond the tolerance.
    """
    texts = [c for c, t in df.dtypes if t == "string" and c in columns]
    n = df.count()
    if last_rows is not None and n < (1 - tolerance) * last_rows:
        raise ValueError(f"{n} rows where the last backup had {last_rows}")
    if texts and (found := {r["kind"]: r["rows"] for r in personal_data(df, texts).collect() if r["rows"]}):
        raise ValueError(f"personal data in the backup: {found}")
    df.select(*columns).write.option("compression", "gzip").json(path)
    back = restore(df, path, columns).count()
    if back != n:
        raise ValueError(f"wrote {n} rows, read back {back}")
    return n


def restore(like: DataFrame, path: str, columns: list[str]) -> DataFrame:
    return like.sparkSession.read.schema(like.select(*columns).schema).json(path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)
