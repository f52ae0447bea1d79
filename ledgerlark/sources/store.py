"""The ledger as a stored table: partitioned by month, bucketed by employer, with statistics.

Queries that name dates read their months only, and joins or groups on the employer need no exchange, as all rows of a key lie in
one bucket of every month. The table lies in the folder that driver and executors share. Its name holds a digest of the files it
was made from, so a catalogue has it once and gets it anew when they change. A bucket is one task where it is joined or grouped by
employer; with an employer that has a large share of all rows, ``spark.sql.sources.bucketing.enabled`` is better off.
"""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import FilterSpec, compile_filters
from ..plans.lineage import shared_dir
from . import ledger as tables

#: So many rows fill a bucket; a month's share of it is one file.
BUCKET_ROWS = 4_000_000
#: So many rows on average are sorted by one task that writes: they are whole rows there, and these fit in its memory.
TASK_ROWS = 250_000
SOURCES = ("orders", "customer", "nation")
#: The partition of rows without a date.
UNDATED = "none"


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the names, sizes and times of the files behind the ledger; only their metadata are read."""
    files = None
    for name in SOURCES:
        own = tables.read(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("at"))
        files = own if files is None else files.unionByName(own)
    mark = files.distinct().agg(F.sum(F.xxhash64("file_path", "file_size", "at").cast("decimal(38,0)")).alias("mark")).first().mark
    return format(int(mark or 0) % (1 << 64), "016x")


def buckets_for(rows: int) -> int:
    return max(2, min(16_384, -(-rows // BUCKET_ROWS)))


def dealt(spark: SparkSession, sf_dir: str, buckets: int, tasks: int) -> DataFrame:
    """The ledger and its ``month``, dealt over tasks by bucket and month. What is dealt are the short rows that it is derived from; a row gets its long texts where it is written."""
    month = lambda day: F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(UNDATED))
    rows = tables.sourced(spark, sf_dir).repartition(tasks, F.pmod(F.hash(tables.company_key()), F.lit(buckets)), month(tables.layoff_date()))
    return tables.derived(tables.keyed(spark, sf_dir, rows).withColumn("month", month("layoff_date")), "month")


def store(rows: DataFrame, name: str, buckets: int) -> None:
    """Write ``rows`` as the table ``name``. Rows come dealt by bucket and month: every month has one file a bucket, and a large employer is spread over its months."""
    spark = rows.sparkSession
    out = rows.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}").option("compression", "zstd")
    out.partitionBy("month").bucketBy(buckets, "company_key").sortBy("company_key", "layoff_date").saveAsTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS id, company_key, layoff_date, job_count")


def kept(spark: SparkSession, name: str) -> bool:
    """Whether the table ``name`` is there with its folder. A table whose folder was deleted, as ``lineage.clean`` does, leaves the catalogue."""
    if not spark.catalog.tableExists(name):
        return False
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first().data_type)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return True
    spark.sql(f"DROP TABLE {name}")
    return False


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger from its table, with its partition column ``month``; written first where it isn't there."""
    name = f"ledger_{fingerprint(spark, sf_dir)}"
    if not kept(spark, name):
        # Orders are the ledger's rows; their number comes from the files' footers.
        rows = tables.read(spark, sf_dir, "orders").count()
        buckets = buckets_for(rows)
        store(dealt(spark, sf_dir, buckets, max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))), name, buckets)
    return spark.table(name)


def months_of(spec: FilterSpec):
    """The test on ``month`` that the dates of ``spec`` imply, or None. Only the effective date is what rows are stored by."""
    if spec.date_basis != "effective":
        return None
    day = lambda d: d is not None and re.fullmatch(r"\d{4}-\d{2}-\d{2}", d) and datetime.date.fromisoformat(d)
    tests = []
    if day(spec.date_from):
        tests.append(F.col("month") >= spec.date_from[:7])
    if day(spec.date_to):
        tests.append(F.col("month") <= spec.date_to[:7])
    if spec.years:
        tests.append(F.substring("month", 1, 4).isin(*map(str, spec.years)))
    if spec.months:
        tests.append(F.substring("month", 6, 2).isin(*[f"{m:02d}" for m in spec.months]))
    if not tests:
        return None
    out = F.col("month") != UNDATED
    for test in tests:
        out = out & test
    return out


def pruned(stored: DataFrame, spec: FilterSpec) -> DataFrame:
    """The rows of a stored ledger that pass ``spec``, read from the months that can hold any."""
    months = months_of(spec)
    return (stored if months is None else stored.where(months)).where(compile_filters(spec))


def executed_after(stored: DataFrame, days: int = 180) -> DataFrame:
    """For each employer the jobs announced, and those executed within so many days of its first announcement: one join on the bucketing key, without an exchange."""
    said = stored.where("announced AND company_key <> '' AND layoff_date IS NOT NULL").groupBy("company_key").agg(F.min("layoff_date").alias("first_day"), F.sum("job_count").alias("announced_jobs"))
    done = stored.where("NOT announced AND layoff_date IS NOT NULL").select("company_key", "layoff_date", "job_count")
    gap = F.datediff("layoff_date", "first_day")
    joined = said.hint("merge").join(done, "company_key").where(gap.between(0, days))
    return joined.groupBy("company_key").agg(F.max("announced_jobs").alias("announced_jobs"), F.sum("job_count").alias("executed_jobs"), F.count(F.lit(1)).alias("executions"))
