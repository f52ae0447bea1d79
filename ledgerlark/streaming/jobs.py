"""Structured Streaming over collector telemetry, run to the end of what is there (``availableNow``).

Every job writes each micro-batch to its own folder by batch number, overwriting it when a batch is repeated, so a restarted job
leaves the same rows; the checkpoint and the output lie in the folder all executors share. What a batch replaces is settled on
reading: the newest batch of each key counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_dir

#: Late data: a live window ends so long behind now. Retries of a slot end after so many attempts, its state after so many days.
LATENESS = "90 minutes"
ATTEMPTS = 6
HORIZON_DAYS = 14


def span(spark: SparkSession, sf_dir: str) -> str:
    """How late a row of a whole table can be when its files come in any order: the time that the table covers.

    A replay with this lateness drops nothing; a live job passes ``LATENESS`` instead and keeps its state small.
    """
    first, last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts"), F.max("ts")).first()
    return LATENESS if first is None else f"{(last - first).days + 1} days"


def files_of(spark: SparkSession, sf_dir: str, name: str, files: int = 64) -> DataFrame:
    """A table as a stream of its files, a few at a time."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern also matches a table that is one file; a plain path would have to be a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def source(spark: SparkSession, sf_dir: str, files: int = 64) -> DataFrame:
    """The telemetry as a stream."""
    return files_of(spark, sf_dir, "events", files).withColumn("at", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str) -> DataFrame:
    """All micro-batches of a stream, with the number of their batch."""
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{home}/out")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")


def tumbling(spark: SparkSession, sf_dir: str, lateness: str | None = None, files: int = 64) -> DataFrame:
    """Events by hour and type; rows later than the lateness are dropped, by default none are."""
    rows = source(spark, sf_dir, files).withWatermark("at", lateness or span(spark, sf_dir))
    counts = rows.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = counts.select(F.col("window.start").alias("hour"), "event_type", "n")
    return newest(run(out, "update"), ["hour", "event_type"]).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def sliding(spark: SparkSession, sf_dir: str, lateness: str | None = None, files: int = 64) -> DataFrame:
    """Events by window of 36 hours, a new one every 12."""
    rows = source(spark, sf_dir, files).withWatermark("at", lateness or span(spark, sf_dir))
    counts = rows.groupBy(F.window("at", "36 hours", "12 hours")).agg(F.count(F.lit(1)).alias("n"))
    return newest(run(counts.select(F.col("window.start").alias("start"), "n"), "update"), ["start"]).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


def deduplicated(spark: SparkSession, sf_dir: str, lateness: str | None = None, files: int = 64) -> DataFrame:
    """Runs seen once, whichever overlapping window delivers them."""
    twice = source(spark, sf_dir, files).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    once = twice.withWatermark("at", lateness or span(spark, sf_dir)).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    return run(once, "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def changed(spark: SparkSession, sf_dir: str, since: str, files: int = 64) -> DataFrame:
    """The feed of rows changed since instrumentation began, in order of arrival; a consumer goes on from its last batch."""
    rows = source(spark, sf_dir, files).where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return run(rows.select("event_id", "ts", "event_type"), "append").select("event_id", "ts", "event_type")


def silence(spark: SparkSession, sf_dir: str, now: str, hours: int) -> DataFrame:
    """Sources whose newest run is older than the limit, by the latest state that the stream keeps of each."""
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(F.col("last_at").cast("timestamp"))) / 3600)
    return health(spark, sf_dir).select("event_type", "last_at", age.alias("hours"), F.when(age > hours, "SILENT").otherwise("OK").alias("verdict"))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each source."""
    latest = source(spark, sf_dir).groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_run"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("runs"))
    return newest(run(latest, "update"), ["event_type"])


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a worker, closed by thirty minutes of silence."""
    rows = source(spark, sf_dir).groupBy(F.session_window("at", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    out = run(rows.select("user_id", F.col("session_window.start").alias("start"), "n"), "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def work_ledger(spark: SparkSession, sf_dir: str, lateness: str | None = None, files: int = 64) -> DataFrame:
    """The state of every (source, day) slot: complete once a run stored all, partial if one stored a part, failed after enough attempts, else queued.

    Each slot has a state of its own (``stateful.Slots``) and is forgotten ``HORIZON_DAYS`` after its day; one that was still open then
    has aged out. Open slots before a complete later one of the same source are superseded, which is settled on reading.
    """
    from . import stateful

    rows = source(spark, sf_dir, files).withWatermark("at", lateness or span(spark, sf_dir)).select("at", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    with stateful.rocks(spark):
        found = newest(run(stateful.slot_states(rows), "update"), ["source", "day"])
    last = found.where("status = 'complete'").groupBy("source").agg(F.max("day").alias("_last"))
    open_ = F.col("status").isin("queued", "failed", "partial") & (F.col("day") < F.col("_last"))
    return found.join(last, "source", "left").withColumn("status", F.when(open_, "superseded").otherwise(F.col("status"))).drop("_last")
