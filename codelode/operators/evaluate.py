"""Retrieval quality: files by first mention, recall and reciprocal rank, a term-frequency baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_files(hits: DataFrame, most: int | None = None) -> DataFrame:
    """``item_id, path, place``: files in the order in which the hits (``item_id, path, place``) first name them."""
    first = hits.groupBy("item_id", "path").agg(F.min("place").alias("first"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("first", "path"))
    rows = first.select("item_id", "path", place.cast("bigint").alias("place"))
    return rows if most is None else rows.where(F.col("place") <= most)


def quality(files: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``item_id, recall, reciprocal_rank`` per query at ``k``; ``gold``: ``item_id, gold ARRAY<STRING>``. A query without gold files or hits has 0."""
    wanted = gold.select("item_id", F.explode(F.array_distinct("gold")).alias("path"))
    found = files.where(F.col("place") <= k).join(wanted, ["item_id", "path"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    sizes = gold.select("item_id", F.greatest(F.size(F.array_distinct(F.coalesce("gold", F.array().cast("array<string>")))), F.lit(1)).alias("size"))
    rows = sizes.join(found, "item_id", "left")
    return rows.select("item_id", F.round(F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)), 9).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("reciprocal_rank"))


def term_frequency(texts: DataFrame, terms: list[str], n: int = 10) -> DataFrame:
    """The ``n`` texts (``path, text``) in which the terms occur most often, without overlaps and regardless of case: ``path, score``."""
    low = F.lower("text")
    score = F.lit(0)
    for t in terms:
        score = score + (F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / F.lit(len(t))
    rows = texts.select("repo", "path", score.cast("bigint").alias("score")).where("score > 0")
    return rows.orderBy(F.desc("score"), "path", "repo").limit(n)
