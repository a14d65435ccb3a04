"""Frequency of every distinct value: a global integer dictionary, count arrays per block, summed by identifier range."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.common import current_records, slots, written

#: Identifiers per range; a count array has this many places.
RANGE = 4096
#: Count arrays that are summed at a time; a task holds so many of 2 * 8 * RANGE bytes, however many blocks there are.
FAN_IN = 64
#: White space around names that is removed.
SPACE = r"\s\x0B\p{Z}"

ARRAYS = "range_id BIGINT, block INT, occurrences ARRAY<BIGINT>, records ARRAY<BIGINT>"


def trimmed(name: Column) -> Column:
    return F.regexp_replace(name, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def file_values(file_parse: DataFrame) -> DataFrame:
    """``repo, path, names``: the trimmed, non-blank callee names (with repeats) of the current record of each file."""
    # a path of fields (not a field inside a lambda) lets the scan read the names alone
    names = F.transform(F.coalesce(F.col("calls.callee_name"), F.array().cast("array<string>")), trimmed)
    current = current_records(file_parse, names.alias("names"))
    return current.select("repo", "path", F.filter("names", lambda n: n.isNotNull() & (n != "")).alias("names"))


def dictionary(values: DataFrame, column: str = "value") -> DataFrame:
    """``value, id``: every distinct value with an integer from 0 on, dense, in byte order of the values.

    Values are range-partitioned and sorted; a first pass counts each partition, a second adds the offset to the place within it. Nothing but one count per partition
    reaches the driver.
    """
    spark = values.sparkSession
    ordered = written(values.select(F.col(column).alias("value")).distinct().repartitionByRange(max(2, slots(spark)), "value").sortWithinPartitions("value").select("value", F.spark_partition_id().alias("part")), "dictionary")
    counts = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, at = {}, 0
    for part in sorted(counts):
        start[part], at = at, at + counts[part]
    offsets = F.create_map(*[F.lit(x) for item in start.items() for x in item]) if start else F.create_map(F.lit(0), F.lit(0))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return ordered.select("value", (place + offsets[F.col("part")]).cast("bigint").alias("id"))


def _arrays(rows: pd.DataFrame) -> pd.DataFrame:
    """Dense count arrays of one (range, block)."""
    at = (rows["id"] % RANGE).to_numpy(np.int64)
    out = [np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)]
    for array, column in zip(out, ("occurrences", "records"), strict=True):
        np.add.at(array, at, rows[column].to_numpy(np.int64))
    return pd.DataFrame({"range_id": [rows["range_id"].iloc[0]], "block": [rows["block"].iloc[0]], "occurrences": [out[0]], "records": [out[1]]})


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum of at most FAN_IN arrays of one range."""
    return pd.DataFrame({"range_id": [rows["range_id"].iloc[0]], "block": [rows["block"].iloc[0]], "occurrences": [np.sum(np.stack(list(rows["occurrences"])), axis=0)], "records": [np.sum(np.stack(list(rows["records"])), axis=0)]})


def value_counts(records: DataFrame, names: str = "names") -> DataFrame:
    """``value, occurrences, records`` over an array column: how often each value occurs and in how many rows of ``records``.

    Each block (map task) counts its own values before anything is shuffled, so a value that makes up a third of all occurrences is one row per block. Null arrays and
    null values count nothing; an empty table gives an empty result.
    """
    blocks = records.select(F.spark_partition_id().alias("block"), F.col(names).alias("names"))
    singles = blocks.select("block", F.explode("names").alias("value"), F.lit(0).alias("record")).where(F.col("value").isNotNull())
    presence = blocks.select("block", F.explode(F.array_distinct("names")).alias("value"), F.lit(1).alias("record")).where(F.col("value").isNotNull())
    counted = singles.unionByName(presence).groupBy("block", "value").agg(F.sum(1 - F.col("record")).alias("occurrences"), F.sum("record").alias("records"))
    counted = written(counted, "block-counts")
    ids = dictionary(counted)
    encoded = counted.join(ids, "value").select("block", (F.col("id") / RANGE).cast("bigint").alias("range_id"), "id", "occurrences", "records")
    arrays = encoded.groupBy("range_id", "block").applyInPandas(_arrays, ARRAYS)
    n_blocks = 1 + (counted.agg(F.max("block").alias("last")).first()["last"] or 0)
    # a tree of sums: each level adds up FAN_IN blocks, so no group grows with the number of blocks
    while n_blocks > 1:
        arrays = arrays.withColumn("block", F.expr(f"CAST(block div {FAN_IN} AS INT)")).groupBy("range_id", "block").applyInPandas(_summed, ARRAYS)
        n_blocks = -(-n_blocks // FAN_IN)
    by_id = arrays.select("range_id", F.posexplode(F.arrays_zip("occurrences", "records")).alias("at", "n")).select((F.col("range_id") * RANGE + F.col("at")).alias("id"), F.col("n.occurrences").alias("occurrences"), F.col("n.records").alias("records"))
    return by_id.where("records > 0").join(ids, "id").select("value", "occurrences", "records")


def marked(counts: DataFrame, n_records: int, least_records: int = 3, most_share: float = 0.1) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``least_records`` records, ``common`` above ``most_share`` of all ``n_records``, else null. A value that is both is ``rare``."""
    return counts.withColumn("mark", F.when(F.col("records") < least_records, "rare").when(F.col("records") > F.lit(most_share) * F.lit(n_records), "common"))


def callee_counts(file_parse: DataFrame) -> DataFrame:
    """``callee_name, occurrences, files, mark`` over the current record of each file; the share is of all files of ``file_parse``."""
    files = written(file_values(file_parse), "file-values")
    n_files = files.count()
    return marked(value_counts(files), n_files).select(F.col("value").alias("callee_name"), "occurrences", F.col("records").alias("files"), "mark")
