"""Learning which terms go with files that were used: trails of searches joined with usage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions.text import norm_query

#: Least share of used candidates for promotion, most for demotion, and what the holdout must confirm.
PROMOTE, DEMOTE, CONFIRM = 0.7, 0.3, 0.5


def groups(trails: DataFrame, usage: DataFrame) -> DataFrame:
    """``group_id, first_path, candidates (path, terms, used)``: each trail (``query, candidates``) whose query, in normal form, was used at all (``query, used``).

    All usage rows of a query count together; an empty list says that nothing was used. Trails without usage are dropped.
    """
    used = usage.select(norm_query("query").alias("norm"), F.explode_outer("used").alias("path")).groupBy("norm").agg(F.collect_set("path").alias("used"))
    rows = trails.withColumn("norm", norm_query("query")).join(used, "norm")
    marked = F.transform("candidates", lambda c: F.struct(c["path"].alias("path"), F.array_distinct(F.coalesce(c["terms"], F.array().cast("array<string>"))).alias("terms"), F.array_contains("used", c["path"]).alias("used")))
    return rows.select(F.coalesce(F.get("candidates", F.lit(0))["path"], F.lit("")).alias("first_path"), "norm", marked.alias("candidates"))


def with_split(groups_: DataFrame, holdout: float) -> DataFrame:
    """Adds ``held``: the last share of the groups by first path, at most all but one, none of fewer than two.

    Groups are numbered without gathering them in one task: a range partitioning by the sort key, a count per partition, and the place inside it.
    """
    ordered = groups_.withColumn("key", F.struct("first_path", "norm"))
    from codelode.common import slots, written

    table = written(ordered.repartitionByRange(max(2, slots(groups_.sparkSession)), "key").withColumn("part", F.spark_partition_id()), "learn-groups")
    counts = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, n = {}, 0
    for part in sorted(counts):
        start[part], n = n, n + counts[part]
    held = min(-(-int(n * holdout * 1_000_000) // 1_000_000), n - 1) if n >= 2 else 0
    offsets = F.create_map(*[F.lit(x) for item in start.items() for x in item]) if start else F.create_map(F.lit(0), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy("key")) + offsets[F.col("part")]
    return table.withColumn("held", place > n - held).drop("part", "key")


def measured(groups_: DataFrame) -> DataFrame:
    """``term, held, n_used, n_total``: candidates that have the term, and those of them that were used."""
    rows = groups_.select("held", F.explode("candidates").alias("c")).select("held", "c.used", F.explode("c.terms").alias("term"))
    return rows.groupBy("term", "held").agg(F.count_if("used").alias("n_used"), F.count(F.lit(1)).alias("n_total"))


def learned(trails: DataFrame, usage: DataFrame, holdout: float = 0.2, least: int = 5) -> DataFrame:
    """``term, polarity (promote, demote), weight``: terms measured at least ``least`` times whose share of use is high (low) and whose holdout, if it has the term, does not contradict."""
    split = measured(with_split(groups(trails, usage), holdout))
    rows = split.groupBy("term").agg(
        F.sum(F.when(~F.col("held"), F.col("n_used"))).alias("used"), F.sum(F.when(~F.col("held"), F.col("n_total"))).alias("total"),
        F.sum(F.when(F.col("held"), F.col("n_used"))).alias("h_used"), F.sum(F.when(F.col("held"), F.col("n_total"))).alias("h_total"),
    )
    p, h = F.col("used") / F.col("total"), F.col("h_used") / F.col("h_total")
    polarity = F.when((p >= PROMOTE) & (h.isNull() | (h >= CONFIRM)), "promote").when((p <= DEMOTE) & (h.isNull() | (h <= CONFIRM)), "demote")
    return rows.where(F.col("total") >= least).select("term", polarity.alias("polarity"), F.lit(1.0).alias("weight")).where("polarity IS NOT NULL")


LEXICON = "term STRING, polarity STRING, weight DOUBLE"
#: Version of a saved lexicon, and the terms that one may hold.
LEXICON_VERSION, MOST_TERMS = 1, 1_000_000


def mark_used(spark: SparkSession, query: str, paths: list[str], usage: str) -> None:
    """Appends that these files were used for a query to the usage feed at ``usage``; at least one file is needed."""
    from codelode.sources import jsonl

    if not paths:
        raise ValueError("mark needs at least one path")
    jsonl.append(spark.createDataFrame([(query, paths)], "query STRING, used ARRAY<STRING>"), usage)


def append_trail(trails: DataFrame, path: str) -> None:
    """Appends trails (``query, candidates (path, terms), values``) to the feed at ``path``."""
    from codelode.sources import jsonl

    jsonl.append(trails, path)


def save_lexicon(terms: DataFrame, path: str, stats: dict[str, int] | None = None) -> None:
    """Writes rows of ``learned`` as one JSON object with sorted terms: ``version, promote, demote, stats``. Bounded: more than MOST_TERMS terms are an error."""
    from codelode.sources.jsonl import _fs

    rows = terms.select("term", "polarity", "weight").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a lexicon of more than {MOST_TERMS} terms")
    sides = {side: {r["term"]: r["weight"] for r in sorted(rows, key=lambda r: r["term"]) if r["polarity"] == side} for side in ("promote", "demote")}
    text = json.dumps({"version": LEXICON_VERSION, **sides, "stats": dict(sorted((stats or {}).items()))}, indent=2, ensure_ascii=False)
    fs, p = _fs(terms.sparkSession, path)
    stream = fs.create(p(path), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``term, polarity, weight`` of a saved lexicon; a missing file is an empty one, a file that is no lexicon an error."""
    from codelode.sources.jsonl import exists

    if not exists(spark, path):
        return spark.createDataFrame([], LEXICON)
    whole = spark.read.schema("version INT, promote MAP<STRING, DOUBLE>, demote MAP<STRING, DOUBLE>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    sides = [whole.select(F.explode(side).alias("term", "weight")).select("term", F.lit(side).alias("polarity"), "weight") for side in ("promote", "demote")]
    return sides[0].unionByName(sides[1])
