"""The parse record as flat tables: one row per symbol, call, import or diagnostic, each with its place in the record (order is data: the first of equal names wins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flat(files: DataFrame, column: str, order: str) -> DataFrame:
    rows = files.select("repo", "path", F.posexplode(column).alias(order, "x")).where(F.col("x").isNotNull())
    return rows.select("repo", "path", F.col(order).cast("bigint").alias(order), "x.*")


def symbols(files: DataFrame) -> DataFrame:
    return _flat(files, "symbols", "sym_ord")


def calls(files: DataFrame) -> DataFrame:
    return _flat(files, "calls", "call_ord")


def imports(files: DataFrame) -> DataFrame:
    return _flat(files, "imports", "imp_ord")


def diagnostics(files: DataFrame) -> DataFrame:
    return _flat(files, "diagnostics", "diag_ord")


def _nested(files: DataFrame, rows: DataFrame, column: str, order: str) -> DataFrame:
    fields = [c for c in rows.columns if c not in ("repo", "path", order)]
    lists = rows.groupBy("repo", "path").agg(F.sort_array(F.collect_list(F.struct(order, F.struct(*fields).alias("x")))).alias("rows"))
    lists = lists.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.transform("rows", lambda x: x["x"]).alias("_list"))
    joined = files.join(lists, F.col("repo").eqNullSafe(F.col("_r")) & (F.col("path") == F.col("_p")), "left")
    return joined.withColumn(column, F.coalesce("_list", F.array().cast(lists.schema["_list"].dataType))).drop("_r", "_p", "_list")


def nested_calls(files: DataFrame, calls_: DataFrame) -> DataFrame:
    """Puts changed call rows back into the files' records, in order. A file without calls gets an empty list."""
    return _nested(files, calls_, "calls", "call_ord")


def nested_imports(files: DataFrame, imports_: DataFrame) -> DataFrame:
    """Puts changed import rows back into the files' records, in order. A file without imports gets an empty list."""
    return _nested(files, imports_, "imports", "imp_ord")
