"""A judge's verdict on search hits: cached answers, an evaluator for the rest, bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.common import written

#: Candidates that a judge sees, characters of a card it gets, version of the questions.
CANDIDATES, CARD_CHARS, VERSION = 20, 2000, 1
#: Least value of each band; below the last a candidate is dropped.
BANDS = (("inline", 0.7), ("include", 0.5), ("lead", 0.25))


def verdict(q: Column, scope: Column) -> Column:
    value = F.least(q, scope)
    out = F.when(value >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:]:
        out = out.when(value >= least, name)
    return out.otherwise("dropped")


def cache_key(model: Column | str, query: Column, candidates: Column) -> Column:
    """Key of a judged list: version, model, query and each candidate's hash and name, in order."""
    model = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat_ws("\x1f", F.lit(str(VERSION)), model, query, F.array_join(F.transform(candidates, lambda c: F.concat_ws("\x1e", c["content_hash"], c["name"])), "\x1d")), 256)


def candidates(hits: DataFrame) -> DataFrame:
    """The first CANDIDATES hits of each query (``item_id``) in order of score, with ``k`` from 0 and the card cut."""
    k = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "path", "name", "line", "hit_id"))
    return hits.withColumn("k", (k - 1).cast("bigint")).where(F.col("k") < CANDIDATES).withColumn("card", F.substring("card", 1, CARD_CHARS))


def payload(rows: DataFrame) -> DataFrame:
    """``item_id, payload``: what a judge gets for a query, as JSON."""
    item = F.struct("k", "path", "line", "kind", "name", "card")
    return rows.groupBy("item_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("candidates"))).alias("payload"))


def answers_of(json: Column, k: Column) -> tuple[Column, Column]:
    """Answers ``q`` and ``scope`` of candidate ``k`` in a judge's JSON; what is missing counts 0."""
    parsed = F.from_json(json, "answers MAP<STRING, STRUCT<noul: DOUBLE>>")["answers"]
    got = lambda name: F.coalesce(F.try_element_at(parsed, F.concat(F.lit(name), k.cast("string")))["noul"], F.lit(0.0))
    return got("q"), got("scope")


def cached(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds the cached answer ``a`` (``q, scope``) to candidates, null where their ``key`` is not in the cache (``key, ord, q, scope``; of equal keys the lowest ``ord`` holds)."""
    known = cache.groupBy("key").agg(F.min_by(F.struct("q", "scope"), "ord").alias("a"))
    return rows.join(known, "key", "left")


def gated(rows: DataFrame, cache: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``q, scope, verdict`` to candidates and removes the dropped ones.

    ``cache``: ``key, ord, q, scope``; of equal keys the lowest ``ord`` holds. Candidates whose ``key`` is not in the cache go to ``evaluate``, which returns ``key, q, scope``
    (of several answers for a key the greatest holds).
    """
    # candidates are at most CANDIDATES rows per query; the join with the cache is written once for hits and misses
    looked = written(cached(rows, cache), "gate-cache")
    hits = looked.where("a IS NOT NULL").select(*rows.columns, "a.q", "a.scope")
    misses = looked.where("a IS NULL").select(*rows.columns)
    fresh = misses.join(evaluate(misses).groupBy("key").agg(F.max(F.struct("q", "scope")).alias("a")).select("key", "a.q", "a.scope"), "key", "left")
    both = hits.unionByName(fresh.select(*rows.columns, F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce("scope", F.lit(0.0)).alias("scope")))
    return both.withColumn("verdict", verdict(F.col("q"), F.col("scope"))).where("verdict <> 'dropped'")
