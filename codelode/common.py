"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process made in shared folders, to be removed by ``release``.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the checkpoint folder of the context. Only on a single machine (a local master, as in tests) one of its own is made where neither is set; a cluster without
    a shared folder is an error, as tables on the executors' own disks would be lost."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/codelode-{os.getuid()}-{os.getpid()}"
    spark.sparkContext.setCheckpointDir(own)
    _MADE.append(own)
    return own


def made(path: str) -> str:
    """Notes a folder for ``release``."""
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Removes all tables, logs and stores that this process has written into the shared folder without being given a path; their number. Results that still read them can't be computed any more."""
    jvm = spark.sparkContext._jvm
    removed = 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        removed += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return removed


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _MADE else None
    if spark is not None:
        with contextlib.suppress(Exception):
            release(spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage by writing ``df`` once into the shared folder and reading it back.

    The copy survives the loss of executors. One call makes one new folder, so a query that runs twice never reads the other run's rows. It is kept until ``release`` or the end of the process.
    """
    spark = df.sparkSession
    path = made(f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slots(spark: SparkSession) -> int:
    """Tasks that run at once; at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)


def current_records(file_parse: DataFrame, *columns: str | Column) -> DataFrame:
    """The current record of each file: latest ``parsed_at``, then latest ``received_at``; keys are (``repo``, ``path``).

    Only the named columns are carried through the shuffle. The choice is an aggregate with map-side combine, so one file with very many
    deliveries makes no large group. Rows that still tie are told apart by the values carried, which makes the result
    repeatable. A null ``parsed_at`` counts as older than any other; rows with a null ``path`` are no file and are left out.
    """
    keep = [F.col(c) if isinstance(c, str) else c for c in columns]
    rows = file_parse.where(F.col("path").isNotNull()).select("repo", "path", F.struct("parsed_at", "received_at").alias("_age"), F.struct(*keep).alias("_kept"))
    picked = rows.groupBy("repo", "path").agg(F.max_by("_kept", "_age").alias("_kept"))
    return picked.select("repo", "path", "_kept.*")
