"""Streams over several files whose rows are not in order of time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import mutations
from ledgerlark.streaming import jobs, snapshots, stateful


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Forty days of events in six files in no order, read one file at a time."""
    rng, home = random.Random(5), str(tmp_path_factory.mktemp("events"))
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randrange(40 * 1440)), rng.randrange(9), rng.choice("abc"), rng.random() * 100) for i in range(900)]
    for k in range(6):
        spark.createDataFrame(rows[k::6], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{home}/events.parquet")
    return home


def test_replays_count_every_row_whatever_the_order(spark, shuffled):
    rows = spark.read.parquet(f"{shuffled}/events.parquet")
    expected = {tuple(r) for r in rows.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type").count().collect()}
    assert {tuple(r) for r in jobs.tumbling(spark, shuffled, files=1).collect()} == expected
    assert sum(r.n for r in jobs.sliding(spark, shuffled, files=1).collect()) == 3 * rows.count()
    assert sum(r.n for r in jobs.deduplicated(spark, shuffled, files=1).collect()) == rows.count()
    assert jobs.changed(spark, shuffled, "2026-01-20", files=1).count() == rows.where("ts >= timestamp_ntz '2026-01-20'").count()


def test_a_live_watermark_drops_what_is_too_late(spark, shuffled):
    kept = sum(r.n for r in jobs.tumbling(spark, shuffled, jobs.LATENESS, files=1).collect())
    assert 0 < kept < 900


def test_slots_age_out_behind_the_horizon(spark, shuffled):
    replay = {(r.source, r.day): r.status for r in jobs.work_ledger(spark, shuffled, files=1).collect()}
    assert "aged out" not in replay.values() and "complete" in replay.values()
    live = {r.status for r in jobs.work_ledger(spark, shuffled, "1 hour", files=1).collect()}
    assert "aged out" in live


def test_silence(spark, shuffled):
    found = {r.event_type: r.verdict for r in jobs.silence(spark, shuffled, "2026-03-01 00:00:00", 24).collect()}
    assert set(found.values()) == {"SILENT"}


def test_zero_streaks_survive_late_and_repeated_rows(spark, shuffled):
    """The same streaks as a sort of all rows, though files come in no order of time and every seventh run comes twice."""
    found = {r.source: (r.streak, r.stored_ever) for r in stateful.streaks_of(spark, shuffled, files=1).collect()}
    expected = {}
    for r in sorted(spark.read.parquet(f"{shuffled}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        entries = 0 if r.event_id % 4 == 0 else int(r.value)
        streak, ever = expected.get(r.event_type, (0, False))
        expected[r.event_type] = (0, True) if entries > 0 else (streak + 1, ever)
    assert found == expected


class Stopped(Exception):
    pass


@pytest.fixture
def entries(spark, tmp_path):
    """Seven files of entries; keys come again in later files, some blank, some edited."""
    schema = "id long, dedup_hash string, company string, job_count long, industry string, edited boolean"
    rng = random.Random(11)
    parts = [[(100 * k + i, f"k{rng.randrange(60)}", "Acme" if i % 9 else "Unknown", rng.randrange(900), rng.choice(["", "IT", "Steel"]), rng.random() < 0.05) for i in range(30)] for k in range(7)]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    merge = lambda old, new: mutations.upsert(old, new.select(*old.columns))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = lambda name: snapshots.Snapshots(spark, f"{tmp_path}/{name}", spark.read.parquet(f"{tmp_path}/in").schema, merge, slots=5)
    return tmp_path, stream, table


@pytest.fixture
def sticky(monkeypatch):
    monkeypatch.setattr(mutations, "STICKY", ("industry",))


def rows_of(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_a_stopped_upsert_stream_goes_on_where_it_was(spark, entries, sticky):
    home, stream, table = entries
    whole, broken = table("whole"), table("broken")
    snapshots.upsert_stream(stream(), whole, f"{home}/c1")
    for stop in (1, 2, 5):
        def after(number, stop=stop):
            if number == stop:
                raise Stopped
        # The batch is merged and its manifest in place, but Spark doesn't know that it is done: it comes again.
        with pytest.raises(Exception, match="Stopped"):
            snapshots.upsert_stream(stream(), broken, f"{home}/c2", after)
        assert broken.manifest()["batch"] == stop
    snapshots.upsert_stream(stream(), broken, f"{home}/c2")
    assert rows_of(broken) == rows_of(whole) and broken.manifest()["version"] == whole.manifest()["version"] == 7
    keys = {r[1] for r in rows_of(whole)}
    assert len(keys) == len(rows_of(whole)) > 40


def test_snapshots_equal_upserts_one_by_one(spark, entries, sticky):
    home, _, table = entries
    own, schema = table("own"), spark.read.parquet(f"{home}/in").schema
    expected = spark.createDataFrame([], schema)
    for number in range(4):
        batch = spark.createDataFrame([(1000 * number + i, f"k{i * (number + 1) % 50}", "Acme", i, "IT" if (i + number) % 3 else "", i % 13 == 0) for i in range(40)], schema)
        assert own.upsert(batch, number) and not own.upsert(batch, number)
        expected = spark.createDataFrame(mutations.upsert(expected, batch).collect(), schema)
    assert rows_of(own) == sorted(map(tuple, expected.collect()))
    assert rows_of(own, 2) != rows_of(own) and own.versions() == [1, 2, 3, 4]


def test_versions_are_put_in_place_once_and_vacuumed(spark, entries, sticky):
    _, _, table = entries
    own = table("own")
    batch = spark.createDataFrame([(i, f"k{i}", "Acme", i, "IT", False) for i in range(40)], own.schema)
    for number in range(4):
        own.upsert(batch.where(f"id >= {10 * number}"), number)
    with pytest.raises(RuntimeError):
        own._commit({"version": 4, "batch": 9, "slots": {}})
    before = rows_of(own)
    assert own.vacuum(1) > 0 and own.versions() == [4] and rows_of(own) == before
    # A batch that touches one slot rewrites that slot alone.
    slots = own.manifest()["slots"]
    own.upsert(batch.where("id = 7").withColumn("job_count", F.lit(-1).cast("long")), 9)
    changed = [s for s, p in own.manifest()["slots"].items() if p != slots[s]]
    assert len(changed) == 1 and {r[3] for r in rows_of(own) if r[0] == 7} == {-1}
