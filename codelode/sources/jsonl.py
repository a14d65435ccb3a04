"""JSON lines: parse records, trails, usage, bindings; reading, appending, replacing at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.schema import record

#: Fields that a record line must have.
REQUIRED = "ir_version path language content_hash byte_len line_count metrics symbols calls imports diagnostics retrieval_card symbol_cards".split()


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file or folder of JSON lines: blank lines are skipped, a line that is no JSON ends the job with an error.

    Optional fields that are missing are null (``is_test`` false); a record that lacks a required field is found by ``incomplete``.
    """
    rows = spark.read.schema(record()).option("mode", "FAILFAST").json(path)
    tested = F.transform("symbols", lambda s: s.withField("is_test", F.coalesce(s["is_test"], F.lit(False))))
    return rows.withColumn("symbols", tested)


def incomplete(records: DataFrame) -> DataFrame:
    """``path, missing``: records without a required field."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    return records.select("path", F.array_join(missing, ", ").alias("missing")).where("missing <> ''")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of lines that are no JSON object, for one file read whole in order; blank lines are none."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("k", "line"))
    return lines.where((F.trim("line") != "") & F.try_parse_json("line").isNull()).select("file", (F.col("k") + 1).cast("bigint").alias("line_no"), "line")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; a missing file is an empty table, a malformed row an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace(rows: DataFrame, path: str) -> None:
    """Writes beside ``path`` first and swaps folders only after the write was committed; a failure leaves the old rows in place."""
    spark = rows.sparkSession
    staged, old = f"{path}.tmp-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    fs, p = _fs(spark, path)
    try:
        rows.write.json(staged)
    except Exception:
        fs.delete(p(staged), True)
        raise
    had = fs.exists(p(path))
    if had:
        fs.rename(p(path), p(old))
    if not fs.rename(p(staged), p(path)):
        if had:
            fs.rename(p(old), p(path))
        raise OSError(f"can't replace {path}")
    if had:
        fs.delete(p(old), True)
