"""Keeping a table of parse records fresh: file changes in, changed records out, batch by batch.

State is a table in versioned folders with a pointer that is swapped after a batch is complete; a batch that fails is run again from the old state. Changes carry no event time: what comes late is simply in a later batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.common import written
from codelode.operators import config, files, resolve
from codelode.operators.tables import nested_calls, nested_imports
from codelode.schema import RECORD_DDL
from codelode.sources.jsonl import _fs

STATE = f"repo STRING, {RECORD_DDL}, digest STRING, fingerprint STRING"
CHANGE = "repo STRING, path STRING, kind STRING, deleted BOOLEAN, seq BIGINT, text STRING"
RELEVANT = ["create", "modify", "remove"]
_CONFIG = r"(^|/)tsconfig[^/]*\.json$"


def latest_per_path(changes: DataFrame) -> DataFrame:
    """Relevant changes (create, modify, remove) inside the repository, the last of each path; a path outside the root is left out."""
    inside = F.col("path").isNotNull() & ~F.startswith("path", F.lit("/")) & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    rows = changes.where(inside & F.col("kind").isin(RELEVANT))
    held = rows.groupBy("repo", "path").agg(F.max_by(F.struct("deleted", "text"), "seq").alias("c"))
    return held.select("repo", "path", F.coalesce("c.deleted", F.lit(False)).alias("deleted"), "c.text")


class RecordState:
    """Parse records by (``repo``, ``path``) with the hash of their text and the fingerprint of their edges."""

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], ignored: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """``parse``: rows ``path, text`` to records; ``ignored``: drops the rows of ignored paths."""
        self.spark, self.path, self.parse, self.ignored = spark, path, parse, ignored or (lambda rows: rows)

    def _version(self) -> int:
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p(self.path)):
            return 0
        done = [s.getPath().getName() for s in fs.listStatus(p(self.path)) if s.getPath().getName().startswith("v")]
        return max((int(n[1:]) for n in done if fs.exists(p(f"{self.path}/{n}/_SUCCESS"))), default=0)

    def read(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(STATE).parquet(f"{self.path}/v{version:09d}") if version else self.spark.createDataFrame([], STATE)

    def configs(self, upto: int | None = None) -> DataFrame:
        """``repo, path, text`` of the configuration files as of the last batch, or of a version."""
        fs, p = _fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p(self.path))] if fs.exists(p(self.path)) else []
        done = [n for n in names if n.startswith("config-") and (upto is None or int(n[7:]) <= upto) and fs.exists(p(f"{self.path}/{n}/_SUCCESS"))]
        schema = "repo STRING, path STRING, text STRING"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{max(done)}") if done else self.spark.createDataFrame([], schema)

    def _keep_configs(self, rows: DataFrame) -> None:
        # named after the version of the state that is about to be written: a batch that is run again writes the same folder
        rows.select("repo", "path", "text").write.mode("overwrite").parquet(f"{self.path}/config-{self._version() + 1:09d}")

    def _write(self, state: DataFrame) -> DataFrame:
        version = self._version() + 1
        state.write.mode("overwrite").parquet(f"{self.path}/v{version:09d}")
        fs, p = _fs(self.spark, self.path)
        fs.delete(p(f"{self.path}/v{version - 2:09d}"), True)
        return self.read()

    def _parsed(self, rows: DataFrame) -> DataFrame:
        """Records of ``repo, path, text`` rows. A record is stored only if it could be parsed, so that a failure is tried again."""
        keyed = rows.withColumn("path", F.concat_ws("\x00", "repo", "path")).select("path", "text")
        records = self.parse(keyed).withColumn("repo", F.substring_index("path", "\x00", 1)).withColumn("path", F.substring_index("path", "\x00", -1))
        digests = rows.select("repo", "path", F.sha2("text", 256).alias("digest"))
        return records.join(digests, ["repo", "path"])

    def _resolved(self, state: DataFrame) -> DataFrame:
        """All records with fresh cross-file edges, fresh links of imports (relative, and by the aliases of the nearest configuration) and fingerprints."""
        reset = F.transform("calls", lambda c: F.when(c["callee_local_key"].isNull(), c.withField("callee_file", F.lit(None).cast("string")).withField("callee_external", F.lit(False))).otherwise(c))
        cleared = state.withColumn("calls", F.coalesce(reset, F.array().cast(state.schema["calls"].dataType)))
        linked = nested_calls(cleared, resolve.across_files(cleared)).withColumn("calls", F.col("calls").cast(state.schema["calls"].dataType))
        imports = state.schema["imports"].dataType
        links = resolve.linked_imports(linked.withColumn("imports", F.coalesce("imports", F.array().cast(imports))), config.effective(self.configs()))
        linked = nested_imports(linked, links).withColumn("imports", F.col("imports").cast(imports))
        prints = files.fingerprints(linked)
        return linked.drop("fingerprint").join(prints, ["repo", "path"]).select(*[c.strip().split(" ")[0] for c in self.spark.createDataFrame([], STATE).columns])

    def snapshot(self, rows: DataFrame) -> DataFrame:
        """Starts over from all files (``repo, path, text``): the state, in which every file counts as updated."""
        kept = self.ignored(rows)
        self._keep_configs(kept.where(F.col("path").rlike(_CONFIG) & F.col("text").isNotNull()))
        parsed = written(self._parsed(kept.where(~F.col("path").rlike(_CONFIG))), "parsed")
        return self._write(self._resolved(parsed.withColumn("fingerprint", F.lit(None).cast("string"))))

    def apply(self, changes: DataFrame, batch: int) -> DataFrame:
        """Applies a batch (see CHANGE) and gives its events ``event, repo, path, content_hash, batch, changed``: deletions, then every record that was parsed anew or whose edges changed though it was not touched, then the end of the batch.

        A path flagged as deleted is gone even if a file is there again; unchanged texts are not parsed; a change of a configuration file resolves everything anew and is no event
        itself. The end comes for an empty batch, too.
        """
        state = self.read()
        last = self.ignored(latest_per_path(changes)).persist()
        settings = last.where(F.col("path").rlike(_CONFIG))
        rows = last.where(~F.col("path").rlike(_CONFIG))
        gone = rows.where("deleted").join(state.select("repo", "path"), ["repo", "path"], "left_semi").select("repo", "path")
        edits = rows.where("NOT deleted AND text IS NOT NULL").withColumn("digest", F.sha2("text", 256)).join(state.select("repo", "path", "digest"), ["repo", "path", "digest"], "left_anti")
        end = lambda n: self.spark.range(1).select(F.lit("batch_end").alias("event"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("content_hash"), F.lit(batch).cast("bigint").alias("batch"), F.lit(n).cast("bigint").alias("changed"))
        if gone.isEmpty() and edits.isEmpty() and settings.isEmpty():
            last.unpersist()
            return end(0)
        parsed = written(self._parsed(edits.select("repo", "path", "text")).withColumn("fingerprint", F.lit(None).cast("string")), f"parsed-{batch}")
        if not settings.isEmpty():
            self._keep_configs(self.configs(self._version()).join(settings.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(settings.where("NOT deleted AND text IS NOT NULL").select("repo", "path", "text")))
        kept = state.join(gone, ["repo", "path"], "left_anti").join(parsed.select("repo", "path"), ["repo", "path"], "left_anti")
        now = self._write(self._resolved(kept.unionByName(parsed.select(*kept.columns))))
        before = state.select("repo", "path", F.col("fingerprint").alias("old"), F.col("digest").alias("old_digest"))
        touched = now.join(before, ["repo", "path"], "left").where(~F.col("fingerprint").eqNullSafe(F.col("old")) | ~F.col("digest").eqNullSafe(F.col("old_digest")))
        n = lambda c: F.lit(c).cast("bigint")
        deleted = gone.select(F.lit("deleted").alias("event"), "repo", "path", F.lit(None).cast("string").alias("content_hash"), n(batch).alias("batch"), n(None).alias("changed"))
        updated = touched.select(F.lit("updated").alias("event"), "repo", "path", "content_hash", n(batch).alias("batch"), n(None).alias("changed"))
        events = written(deleted.unionByName(updated), f"events-{batch}")
        last.unpersist()
        return events.unionByName(end(events.count()))


def run(stream: DataFrame, state: RecordState, sink: str, checkpoint: str, interval: str = "200 milliseconds", once: bool = False):  # noqa: ANN201
    """Applies a stream of changes; each micro-batch's events are appended to ``sink`` as JSON lines. A batch that is run again after a failure overwrites its own folder, so no event is doubled."""

    def one(batch: DataFrame, number: int) -> None:
        events = state.apply(batch, number)
        rank = F.when(F.col("event") == "deleted", 0).when(F.col("event") == "updated", 1).otherwise(2)
        events.orderBy(rank, "repo", "path").coalesce(1).write.mode("overwrite").json(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
