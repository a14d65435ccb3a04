"""Ranked search over files and symbols."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import tokenize

#: Weights of term overlap and of the fuzzy name match; points of a fuzzy match per query byte; the most that a lexicon moves a score.
W_TERMS, W_FUZZY, FUZZY_POINTS, BOOST = 0.6, 0.4, 12.0, 0.2
_PYTHON_TOKEN = re.compile(r"[^\W_]+")


def units(files: DataFrame) -> DataFrame:
    """``repo, path, line, kind, name, content_hash, terms, target, card, est_tokens``: one unit per file and per symbol.

    A symbol's terms come from its name, signature, documentation and card, with repeats; a file's are the distinct sorted terms of its card, documentation, imports and all its symbols. Null
    texts give no terms.
    """
    words = lambda *texts: tokenize(F.concat_ws(" ", *texts))
    cards = F.coalesce("symbol_cards", F.array())
    symbol = F.transform(F.coalesce("symbols", F.array()), lambda s, k: F.struct(
        s["start_line"].alias("line"), s["kind"].alias("kind"), s["qualified_name"].alias("name"), words(s["qualified_name"], s["signature"], s["docstring"], F.get(cards, k)["text"]).alias("terms"),
        F.coalesce(F.get(cards, k)["text"], F.lit("")).alias("card"), F.coalesce(F.get(cards, k)["est_tokens"], F.lit(0).cast("bigint")).alias("est_tokens"),
    ))
    imported = F.flatten(F.transform(F.coalesce("imports", F.array()), lambda i: words(i["import_name"], i["target_module"])))
    own = F.concat(words(F.col("retrieval_card.text"), "docstring"), imported)
    rows = files.select("repo", "path", "content_hash", symbol.alias("s"), own.alias("own"), "retrieval_card")
    all_terms = F.array_sort(F.array_distinct(F.concat("own", F.flatten(F.transform("s", lambda x: x["terms"])))))
    of_files = rows.select(
        "repo", "path", F.lit(0).cast("bigint").alias("line"), F.lit("file").alias("kind"), F.col("path").alias("name"), "content_hash", all_terms.alias("terms"), F.col("path").alias("target"),
        F.coalesce("retrieval_card.text", F.lit("")).alias("card"), F.coalesce("retrieval_card.est_tokens", F.lit(0).cast("bigint")).alias("est_tokens"),
    )
    of_symbols = rows.select("repo", "path", "content_hash", F.explode("s").alias("s")).select("repo", "path", "s.line", "s.kind", "s.name", "content_hash", "s.terms", F.col("s.name").alias("target"), "s.card", "s.est_tokens")
    return of_files.unionByName(of_symbols)


def document_frequency(units_: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """``term, df``: in how many units each term occurs; of the given terms only, if there are any (the rest is dropped before the shuffle)."""
    rows = units_.select(F.explode(F.array_distinct("terms")).alias("term"))
    return (rows if terms is None else rows.where(F.col("term").isin(terms))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(query: str) -> list[str]:
    """A query's terms, as ``tokenize`` gives them; repeats count."""
    spaced = re.sub(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])|(?<=[A-ZÀ-ÖØ-Þ]{2})(?=[a-zß-öø-ÿ])", " ", query)
    return [w.lower() for w in _PYTHON_TOKEN.findall(spaced)]


def _totals(units_: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Number of units, and of units per query term: one row comes to the driver."""
    distinct = sorted(set(terms))
    row = units_.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("terms", t)).alias(f"t{k}") for k, t in enumerate(distinct)]).first()
    return row["n"], {t: row[f"t{k}"] for k, t in enumerate(distinct)}


def overlap(units_: DataFrame, terms: list[str]) -> Column:
    """Share of the query's inverse document frequencies that a unit's terms carry. Terms that no unit has weigh most, repeated query terms weigh twice."""
    import math

    n, df = _totals(units_, terms)
    idf = {t: math.log(1 + n / (1 + df[t])) for t in df}
    total = sum(idf[t] for t in terms)
    if total <= 0:
        return F.lit(0.0)
    got = F.lit(0.0)
    for t in terms:
        got = got + F.when(F.array_contains("terms", t), F.lit(idf[t])).otherwise(0.0)
    return got / F.lit(total)


def subsequence_score(text: str, pattern: str) -> int | None:
    """Best score of ``pattern`` as a subsequence of ``text`` without regard to case (with it, if the pattern has capitals); None if it is none.

    Points: 16 per letter; 8 at the begin of a word and 7 at a rise to a capital or digit, doubled for the first letter; 4 at least where letters follow each other; gaps cost 3 and 1 per further letter.
    """
    if not pattern:
        return None
    fold = not any(c.isupper() for c in pattern)
    t, q = (text.lower(), pattern) if fold else (text, pattern)
    at = -1
    for c in q:
        at = t.find(c, at + 1)
        if at < 0:
            return None
    n = len(t)
    bonus = [0] * n
    for k in range(n):
        before = text[k - 1] if k else ""
        if k == 0 or not before.isalnum():
            bonus[k] = 8
        elif before.islower() and text[k].isupper() or before.isalpha() and text[k].isdigit():
            bonus[k] = 7
    low = -(10**9)
    best = [low] * n  # with the current letter matched at k
    runs = [0] * n
    for row, c in enumerate(q):
        new, new_runs, carried = [low] * n, [0] * n, low
        for k in range(n):
            if row and k >= 2:
                carried = max(carried - 1, best[k - 2] - 3)
            if t[k] != c:
                continue
            if row == 0:
                new[k], new_runs[k] = 16 + 2 * bonus[k], bonus[k]
                continue
            if carried > low // 2:
                new[k], new_runs[k] = carried + 16 + bonus[k], bonus[k]
            if k and best[k - 1] > low // 2:
                extra = max(bonus[k], runs[k - 1], 4)
                if best[k - 1] + 16 + extra > new[k]:
                    new[k], new_runs[k] = best[k - 1] + 16 + extra, max(runs[k - 1], bonus[k])
        best, runs = new, new_runs
    found = max(best)
    return found if found > low // 2 else None


def fuzzy(query: str, target: Column) -> Column:
    """Fuzzy match of a name with the raw query, between 0 and 1; null where the query is no subsequence. Only targets that pass a JVM-side subsequence test reach Python, in Arrow batches."""
    most = len(query.encode()) * FUZZY_POINTS

    @F.pandas_udf("double")
    def score(names: pd.Series) -> pd.Series:
        known: dict[str, float | None] = {}
        out = []
        for name in names:
            if name is not None and name not in known:
                s = subsequence_score(name, query)
                known[name] = None if s is None else min(max(s, 0) / most, 1.0)
            out.append(known.get(name))
        return pd.Series(out, dtype="float64")

    loose = ".*".join(re.escape(c) for c in query)
    flags = "" if any(c.isupper() for c in query) else "(?i)"
    return score(F.when(target.rlike(f"{flags}(?s){loose}"), target))


def boost(terms: Column, promote: list[str], demote: list[str]) -> Column:
    """What a lexicon adds to a score: for each occurrence of a term, within the limits."""
    up = F.size(F.filter(terms, lambda t: t.isin(promote))) if promote else F.lit(0)
    down = F.size(F.filter(terms, lambda t: t.isin(demote))) if demote else F.lit(0)
    return F.greatest(F.lit(-BOOST), F.least(F.lit(BOOST), (up - down) * F.lit(BOOST)))


def top(hits: DataFrame, n: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "path", "name", "line", "repo").limit(n)


def search(units_: DataFrame, query: str, n: int = 20, lexicon: tuple[list[str], list[str]] | None = None, with_fuzzy: bool = True) -> DataFrame:
    """The ``n`` best hits: ``repo, path, line, kind, name, score, content_hash, tokens_est, card``.

    ``re:<pattern>`` filters by target or card instead, all with score 1. An empty query and one without letters or digits are errors. Scores are rounded to nine digits.
    """
    query = query.strip()
    if not query:
        raise ValueError("empty query")
    keep = ["repo", "path", "line", "kind", "name", "score", "content_hash", F.col("est_tokens").alias("tokens_est"), "card"]
    if query.startswith("re:"):
        pattern = query[3:]
        if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
            raise ValueError("look-around and back references are not supported")
        re.compile(pattern)
        return top(units_.where(F.col("target").rlike(pattern) | F.col("card").rlike(pattern)).withColumn("score", F.lit(1.0)).select(*keep), n)
    terms = query_terms(query)
    if not terms:
        raise ValueError("query has no alphanumeric terms")
    score = F.lit(W_TERMS) * overlap(units_, terms)
    if with_fuzzy:
        score = score + F.lit(W_FUZZY) * F.coalesce(fuzzy(query, F.col("target")), F.lit(0.0))
    if lexicon is not None:
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.5), score + boost(F.col("terms"), *lexicon)))
    return top(units_.withColumn("score", F.round(score, 9)).where("score > 0").select(*keep), n)


def batch_search(units_: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best units of each query by term overlap: ``item_id, repo, path, line, name, score, place``. ``queries``: ``item_id, query``.

    Query terms (few, bounded by the query table, whose size is checked by the engine before a broadcast) are joined with the exploded unit terms; each query's candidates are reduced by a
    ranking aggregate before the final order.
    """
    from pyspark.sql import Window

    asked = queries.select("item_id", F.posexplode(tokenize("query")).alias("k", "term"))
    rows = units_.withColumn("unit", F.struct("repo", "path", "line", "name", "kind"))
    n_units = F.lit(float(units_.count()))
    have = rows.select("unit", F.explode(F.array_distinct("terms")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = have.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = asked.join(df, "term", "left").withColumn("idf", F.log(1 + n_units / (1 + F.coalesce("df", F.lit(0)))))
    total = idf.groupBy("item_id").agg(F.sum("idf").alias("total"))
    weights = idf.where("df IS NOT NULL").groupBy("item_id", "term").agg(F.sum("idf").alias("idf"))
    got = have.join(weights, "term").groupBy("item_id", "unit").agg(F.sum("idf").alias("idf")).join(total, "item_id")
    scored = got.select("item_id", "unit.*", F.round(F.col("idf") / F.col("total"), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "path", "name", "line", "repo", "kind"))
    return scored.withColumn("place", place.cast("bigint")).where(F.col("place") <= n).drop("kind")
