"""Applying a feed of inserts, updates and deletes: a log-structured merge over tables in the shared folder.

Each delivery is appended as a run, sorted by key and sequence and already reduced to the latest change of each key (deletes stay as tombstones). Runs are cut into the same parts by a hash of
the key. A read merges the sorted runs of each part (k-way merge with a heap) and lets tombstones hide what they delete; compaction writes that merge as one run, tombstones included, as a change
of lower sequence may still be on its way. What runs are live stands in numbered manifests: a reader keeps the runs of the manifest that it began with, and compacted
runs are removed only after a later compaction.
"""

from __future__ import annotations

import heapq
import json
import uuid
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.common import made, shared_dir, slots

RUN_SCHEMA = "repo STRING, path STRING, seq BIGINT, arrival_no BIGINT, alive BOOLEAN, content_hash STRING"
COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
#: Changes that a part of a log may hold, roughly; what one task merges at a time.
PART_ROWS = 200_000


def plain_path(path: Column) -> Column:
    """Forward slashes, without any leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./+)+", "")


def changes_of(feed: DataFrame) -> DataFrame:
    """The feed's inserts, updates and deletes in one form: ``repo, path, seq, arrival_no, alive, content_hash``.

    Event names are compared without case and surrounding blanks; other events (batch ends) are no changes. The path of an update is ``path``, or where that is null the path in
    ``ir``. Changes without sequence number or path can't be applied to anything and are left out.
    """
    event = F.lower(F.trim("event"))
    path = plain_path(F.coalesce("path", F.when(event == "updated", F.col("ir.path"))))
    rows = feed.where(event.isin("updated", "deleted") & F.col("seq").isNotNull()).select(
        "repo", path.alias("path"), F.col("seq").cast("bigint").alias("seq"), F.col("arrival_no").cast("bigint").alias("arrival_no"),
        (event == "updated").alias("alive"), F.when(event == "updated", F.col("ir.content_hash")).alias("content_hash"),
    )
    return rows.where(F.col("path").isNotNull())


def latest(changes: DataFrame) -> DataFrame:
    """The change of highest ``seq`` per key; of equal ``seq`` (the same change delivered again) the one that arrived last.

    An aggregate with map-side combine: a key that holds a third of the feed is reduced to one row per map task before the shuffle.
    """
    held = changes.groupBy("repo", "path").agg(F.max(F.struct("seq", "arrival_no", "alive", "content_hash")).alias("c"))
    return held.select("repo", "path", "c.seq", "c.arrival_no", "c.alive", "c.content_hash")


def state_after(changes: DataFrame) -> DataFrame:
    """Files alive after the latest change of each key."""
    return latest(changes).where("alive").select("repo", "path", "content_hash")


def _key(row: tuple) -> tuple:
    """Order of a run: repository (null first), path, sequence, arrival; what decides between changes that tie comes last."""
    repo, path, seq, arrival, alive, digest = row
    return (repo is not None, repo or "", path, seq, arrival is not None, arrival or 0, alive, digest is not None, digest or "")


def merge_runs(runs: list[list[tuple]]) -> list[tuple]:
    """K-way merge of sorted runs: the latest change of each key, in order of the keys."""
    for run in runs:
        # files are written in order and a shuffle keeps it; should a reader ever split and swap pieces of one, its order is restored
        if any(_key(a) > _key(b) for a, b in pairwise(run)):
            run.sort(key=_key)
    out = []
    for _, same in groupby(heapq.merge(*runs, key=_key), key=lambda row: row[:2]):
        for row in same:
            latest_row = row
        out.append(latest_row)
    return out


def _merged_part(rows: pa.Table) -> pa.Table:
    runs: dict[str, list[tuple]] = {}
    columns = [rows.column(c).to_pylist() for c in COLUMNS]
    for run, row in zip(rows.column("run").to_pylist(), zip(*columns, strict=True), strict=True):
        runs.setdefault(run, []).append(row)
    merged = merge_runs(list(runs.values()))
    kept = list(zip(*merged, strict=True))
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.table({"part": pa.array([rows.column("part")[0].as_py()] * len(merged), pa.int32()), **{c: pa.array(v, t) for c, v, t in zip(COLUMNS, kept, types, strict=True)}})


class ChangeLog:
    """A table of runs under ``path``: ``runs/<id>/run=<n>/part=<k>`` and ``log/<number>.json``, one per change of the list of live runs.

    Appending a run that was appended before changes nothing in what a read gives (changes are idempotent by ``seq``), so a failed append is simply repeated: a run that no
    manifest names does not exist. ``parts`` is fixed when the log is made; a log that is there already keeps its own. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, most_runs: int = 8, parts: int | None = None) -> None:
        self.spark, self.most_runs = spark, most_runs
        self.path = path or made(f"{shared_dir(spark)}/change-log-{uuid.uuid4().hex}")
        self.parts = self._manifest().get("parts") or parts or slots(spark)

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifest(self) -> dict:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/log")):
            return {"number": 0, "runs": [], "retired": []}
        last = max(s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/log")) if s.getPath().getName().endswith(".json"))
        stream = fs.open(path(f"{self.path}/log/{last}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, runs: list[str], retired: list[str]) -> None:
        number = self._manifest()["number"] + 1
        fs, path = self._fs()
        draft = path(f"{self.path}/log/.{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps({"number": number, "parts": self.parts, "runs": runs, "retired": retired}).encode()))
        stream.close()
        if not fs.rename(draft, path(f"{self.path}/log/{number:09d}.json")):
            raise RuntimeError(f"manifest {number} of {self.path} was written by somebody else")

    def runs(self) -> list[str]:
        """Live runs, oldest first."""
        return self._manifest()["runs"]

    def compactions(self) -> int:
        """How often the log was compacted."""
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/runs"))] if fs.exists(path(f"{self.path}/runs")) else []
        return sum(n.startswith("compacted-") for n in names)

    def _write(self, changes: DataFrame, run: Column, name: str) -> None:
        keys = ["run", "part", "repo", "path"]
        rows = changes.withColumn("run", run).withColumn("part", F.pmod(F.hash("repo", "path"), F.lit(self.parts)))
        held = rows.groupBy(*keys).agg(F.max(F.struct("seq", "arrival_no", "alive", "content_hash")).alias("c")).select(*keys, "c.*")
        # one file per run and part, sorted by key
        held.repartition(min(self.parts, 4 * slots(self.spark)), "part").sortWithinPartitions("run", "part", "repo", "path").write.partitionBy("run", "part").parquet(f"{self.path}/runs/{name}")

    def append(self, changes: DataFrame, delivery: Column | None = None) -> None:
        """Adds the changes as a run, or as one run per value of ``delivery`` in its order; all of them are written in one pass over the changes. Compacts whenever there are more than ``most_runs``."""
        name = f"appended-{uuid.uuid4().hex}"
        self._write(changes, (delivery if delivery is not None else F.lit(0)).cast("int"), name)
        fs, path = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/runs/{name}"))]
        for number in sorted(int(n.split("=")[1]) for n in found if n.startswith("run=")):
            manifest = self._manifest()
            self._publish([*manifest["runs"], f"{name}/run={number}"], manifest["retired"])
            if len(self.runs()) > self.most_runs:
                self.compact()

    def merged(self) -> DataFrame:
        """The latest change of each key over all live runs, tombstones included: one k-way merge per part."""
        return self._merge(self.runs()).select(*COLUMNS)

    def _merge(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], f"part INT, {RUN_SCHEMA}")
        each = [self.spark.read.schema(f"{RUN_SCHEMA}, part INT").parquet(f"{self.path}/runs/{run}").withColumn("run", F.lit(run)) for run in runs]
        rows = each[0]
        for more in each[1:]:
            rows = rows.unionByName(more)
        return rows.repartition(min(self.parts, 100 * slots(self.spark)), "part").groupBy("part").applyInArrow(_merged_part, f"part INT, {RUN_SCHEMA}")

    def read(self) -> DataFrame:
        """The current state of the table: merge on read, tombstones hide what they delete."""
        return self.merged().where("alive").select("repo", "path", "content_hash")

    def compact(self) -> None:
        """Merges all runs into one; what an earlier compaction retired is removed now."""
        manifest = self._manifest()
        if len(manifest["runs"]) < 2:
            return
        name = f"compacted-{uuid.uuid4().hex}"
        self._merge(manifest["runs"]).withColumn("run", F.lit(0)).sortWithinPartitions("run", "part", "repo", "path").write.partitionBy("run", "part").parquet(f"{self.path}/runs/{name}")
        self._publish([f"{name}/run=0"], manifest["runs"])
        fs, path = self._fs()
        for run in manifest["retired"]:
            fs.delete(path(f"{self.path}/runs/{run}"), True)


def change_log(feed: DataFrame, deliveries: int = 12) -> ChangeLog:
    """A change log of the whole feed: it arrives in ``deliveries`` equal stretches of ``arrival_no``, each appended as a run, in one pass; more than eight runs are compacted on the way."""
    changes = changes_of(feed)
    told = changes.agg(F.count(F.lit(1)).alias("n"), F.min("arrival_no").alias("first"), F.max("arrival_no").alias("last")).first()
    log = ChangeLog(feed.sparkSession, parts=max(slots(feed.sparkSession), -(-told["n"] // PART_ROWS)))
    first, last = told["first"] or 0, told["last"] or 0
    log.append(changes, F.coalesce(((F.col("arrival_no") - first) * deliveries / F.lit(last - first + 1)).cast("int"), F.lit(0)))
    return log


def replayed(feed: DataFrame, deliveries: int = 12) -> DataFrame:
    """The state after the whole feed, built through a change log and merged on read. An empty feed holds nothing."""
    return change_log(feed, deliveries).read()
