"""How distinctive a term is per record: divergence from randomness with a geometric collection model and Laplace after-effect.

For a term with frequency ``tf`` in a unit of length ``len``, ``F`` occurrences in all ``N`` units and mean unit length ``avg``:
``tfn = tf * log2(1 + C * avg / len)``, ``lambda = F / N``, information ``log2(1 + lambda) + tfn * log2((1 + lambda) / lambda)``, gain ``1 / (tfn + 1)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.common import written

#: The free parameter of the length normalisation. The gain saturates with tfn, so a term that occurs twice, in one unit only, may outrank one that occurs eight times and in five units; tf-idf and BM25, which
#: saturate less, differ in 9 of 2666 probed units of check_l. A smaller value would mend these, but puts common terms before rare ones in small collections.
C = 1.0
#: A term in more than this share of all units is joined by broadcast: there can't be more such terms than (mean distinct terms per unit) / share.
HOT_SHARE = 0.01


def _usable(terms: str) -> Column:
    return F.coalesce(F.filter(terms, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def unit_terms(units: DataFrame) -> DataFrame:
    """One row per unit and distinct term: ``unit_id, term, tf, len, leads``; ``leads`` is true in one row of each unit.

    A unit delivered several times counts once: of its rows the one with the longest term list holds, then the greatest list. Null lists, null terms and
    empty terms give no row; a null ``unit_id`` is no unit. Terms are compared as stored. Terms are counted inside the unit's sorted list, so nothing but the units is shuffled.
    """
    once = units.where(F.col("unit_id").isNotNull()).select("unit_id", F.array_sort(_usable("terms")).alias("terms")).where(F.size("terms") > 0)
    once = once.groupBy("unit_id").agg(F.max_by("terms", F.struct(F.size("terms"), F.col("terms"))).alias("terms"))
    begins = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda k: (k == 0) | (F.get("terms", k) != F.get("terms", k - 1)))
    counted = once.select("unit_id", "terms", F.size("terms").cast("bigint").alias("len"), begins.alias("begins"))
    rows = counted.select("unit_id", "len", "terms", "begins", F.posexplode("begins").alias("nth", "at"))
    end = F.coalesce(F.get("begins", F.col("nth") + 1).cast("bigint"), F.col("len"))
    return rows.select("unit_id", F.get("terms", F.col("at")).alias("term"), (end - F.col("at")).alias("tf"), "len", (F.col("nth") == 0).alias("leads"))


def _join_statistics(rows: DataFrame, statistics: DataFrame, n_units: float) -> DataFrame:
    """Adds ``F`` to each row. Very frequent terms (few by arithmetic, see HOT_SHARE) come by broadcast, so that no task gets all rows of a hot term; the rest by a shuffle on the term."""
    least = max(1000.0, HOT_SHARE * n_units)
    hot = F.broadcast(statistics.where(F.col("df") >= least).select("term", F.col("cf").alias("hot_cf")))
    split = rows.join(hot, "term", "left")
    common = split.where(F.col("hot_cf").isNotNull()).withColumnRenamed("hot_cf", "cf")
    rest = split.where(F.col("hot_cf").isNull()).drop("hot_cf").join(statistics.where(F.col("df") < least).select("term", "cf"), "term")
    return common.select(*rest.columns).unionByName(rest)


def weight(tf: Column, length: Column, cf: Column, n_units: float, mean_length: float, c: float = C) -> Column:
    """The weight of a term in a unit, see the module's text. Columns may hold any positive numbers."""
    tfn = tf * F.log2(F.lit(1.0) + F.lit(c * mean_length) / length)
    rate = cf / F.lit(n_units)
    return (F.log2(F.lit(1.0) + rate) + tfn * F.log2((F.lit(1.0) + rate) / rate)) / (tfn + F.lit(1.0))


def term_scores(units: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """``unit_id, term, tf, score`` for every distinct term of every unit, or of the units in ``probes`` (column ``unit_id``).

    The collection statistics always cover all units. A unit without terms gets no row, an empty table gives an empty result.
    Scores are rounded to nine digits, so that the order of summation does not show.
    """
    pairs = written(unit_terms(units), "unit-terms")
    statistics = written(pairs.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")), "term-statistics")
    whole = pairs.where("leads").agg(F.count(F.lit(1)).alias("n_units"), F.avg("len").alias("mean_length")).first()
    n_units, mean_length = float(max(1, whole["n_units"])), float(whole["mean_length"] or 1.0)
    pairs = pairs.drop("leads")
    rows = pairs if probes is None else pairs.join(probes.select("unit_id").where(F.col("unit_id").isNotNull()).distinct(), "unit_id", "left_semi")
    scored = _join_statistics(rows, statistics, n_units)
    return scored.select("unit_id", "term", "tf", F.round(weight(F.col("tf"), F.col("len"), F.col("cf"), n_units, mean_length), 9).alias("score"))


def leading_terms(scores: DataFrame) -> DataFrame:
    """The term of highest score per unit; of equal scores the more frequent one in the unit, then the first by bytes."""
    # one aggregate: the greatest score and frequency, and among those the least term
    ranked = scores.groupBy("unit_id", "score", "tf").agg(F.min("term").alias("term"))
    return ranked.groupBy("unit_id").agg(F.max_by("term", F.struct("score", "tf")).alias("term"))
