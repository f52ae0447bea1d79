"""Versioned snapshots of a keyed table, and a stream that upserts into them.

A snapshot is a set of folders, one or more for each slot of the key's hash; a manifest names them, and the manifest of the greatest
version is the table. A merge writes new folders only for the slots that a batch touches and then puts the next manifest in place by
one rename, so readers see a version whole or not at all, and a task or driver lost on the way leaves only folders that no manifest
names. A manifest also names the last batch of the stream that it holds: a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutations
from ..plans.lineage import shared_dir
from ..sources import ledger as tables
from . import jobs

SLOTS = 64


class Snapshots:
    """Snapshots under ``home``, a folder that driver and executors share; ``merge(old, new)`` gives the rows that replace ``old``."""

    def __init__(self, spark: SparkSession, home: str, schema, merge: Callable[[DataFrame, DataFrame], DataFrame], key: str = "dedup_hash", slots: int = SLOTS):
        self.spark, self.home, self.schema, self.merged, self.key, self.slots = spark, home, schema, merge, key, slots
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{home}/{name}")
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path("versions"))

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._files.listStatus(self._path("versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds; the newest one by default, an empty one before the first."""
        held = self.versions()
        if not held:
            return {"version": 0, "batch": -1, "slots": {}}
        (line,) = self.spark.read.text(f"{self.home}/versions/{version or held[-1]:012d}.json").collect()
        return json.loads(line.value)

    def read(self, version: int | None = None, slots: list[int] | None = None) -> DataFrame:
        """The rows of a version, of all slots or of some."""
        held = self.manifest(version)["slots"]
        paths = [p for s, own in held.items() for p in own if slots is None or int(s) in slots]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _commit(self, manifest: dict) -> None:
        """Puts a manifest in place; fails if another writer was first, as a rename never replaces a file."""
        draft, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{manifest['version']:012d}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} was written by another job")

    def upsert(self, batch: DataFrame, number: int) -> bool:
        """Merge a batch; whether it changed anything. A batch not newer than the last one merged is known already."""
        now = self.manifest()
        if number <= now["batch"]:
            return False
        touched = sorted(r.slot for r in batch.select(self._slot().alias("slot")).distinct().collect())
        fresh = self._write(self.merged(self.read(slots=touched), batch), now["version"] + 1) if touched else {}
        # A slot that the merge emptied has no folder any more.
        left = {s: own for s, own in now["slots"].items() if int(s) not in touched}
        self._commit({"version": now["version"] + 1, "batch": number, "slots": left | fresh})
        return True

    def begin(self, rows: DataFrame) -> None:
        """The first version, with ``rows`` as they are."""
        self._commit({"version": 1, "batch": -1, "slots": self._write(rows, 1)})

    def _slot(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.slots)).cast("int")

    def _write(self, rows: DataFrame, version: int) -> dict[str, list[str]]:
        """Writes rows by slot; the folders of the slots that have any."""
        name = f"data/{version:012d}-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn("_slot", self._slot()).write.partitionBy("_slot").parquet(f"{self.home}/{name}")
        found = [f.getPath().getName() for f in self._files.listStatus(self._path(name))]
        return {n.removeprefix("_slot="): [f"{self.home}/{name}/{n}"] for n in found if n.startswith("_slot=")}

    def vacuum(self, keep: int = 2) -> int:
        """Delete the versions before the last ``keep`` and all folders that none of these names; how many folders went.

        Folders of a merge that is under way are named by no manifest yet, so this is run by the writer between batches.
        """
        held = self.versions()
        for version in held[:-keep]:
            self._files.delete(self._path(f"versions/{version:012d}.json"), False)
        named = {p for v in held[-keep:] for own in self.manifest(v)["slots"].values() for p in own}
        gone = 0
        if self._files.exists(self._path("data")):
            for folder in self._files.listStatus(self._path("data")):
                name = folder.getPath().getName()
                own = [f"{self.home}/data/{name}/{s.getPath().getName()}" for s in self._files.listStatus(folder.getPath())]
                if not named.intersection(own):
                    self._files.delete(folder.getPath(), True)
                    gone += 1
        return gone


def upsert_stream(stream: DataFrame, table: Snapshots, checkpoint: str, after: Callable[[int], None] | None = None, keep: int = 2) -> None:
    """Upsert all that a stream has; ``after`` is called behind each batch (tests stop the job there)."""

    def put(batch: DataFrame, number: int) -> None:
        # The batch is read more than once: for its slots and for the merge.
        held = batch.persist()
        try:
            table.upsert(held, number)
        finally:
            held.unpersist()
        if after:
            after(number)
        table.vacuum(keep)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted_ledger(spark: SparkSession, sf_dir: str, files: int = 64) -> DataFrame:
    """A snapshot of two thirds of the ledger, with every fifth entry of the order stream put in as new: the last version."""
    home = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    old = tables.ledger(spark, sf_dir).where("id % 3 <> 0")
    table = Snapshots(spark, f"{home}/table", old.schema, mutations.upsert)
    table.begin(old)
    new = tables.ledger(spark, sf_dir, jobs.files_of(spark, sf_dir, "orders", files)).where("id % 5 = 0")
    new = new.withColumns({"industry": F.when(F.col("id") % 2 == 0, "").otherwise("NEW"), "id": F.col("id") + 1000000, "job_count": F.col("job_count") + 1})
    upsert_stream(new, table, f"{home}/checkpoint")
    return table.read()
