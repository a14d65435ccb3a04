"""Source files that do not parse.

Every file is parsed against all supported grammars, in the order in which its tokens speak for the languages. A file that breaks the grammar of its own extension and follows another has
a wrong extension; one that follows none is corrupt.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.common import current_records
from codelode.sources.grammar import LANGUAGES, grammars, language_of

JUDGED = "repo STRING, path STRING, language STRING, verdict STRING, parses_as STRING, follows ARRAY<STRING>"


def verdict(text: str, language: str) -> tuple[str, str | None, list[str]]:
    """What a text is, the language it is taken for, and all languages whose grammar it follows, the likeliest first.

    ``ok``; ``wrong_extension`` (breaks its own grammar, follows another); ``corrupt`` (follows none); ``too_deep`` (nested deeper than the parser of its own language can follow, so nothing is known).
    """
    if not text.strip():
        return "ok", language, list(LANGUAGES)
    found = grammars(text)
    follows = [name for name, yes in found.items() if yes]
    if found[language]:
        return "ok", language, follows
    if found[language] is None:
        return "too_deep", None, follows
    # nearly every text that is a script is TypeScript too, and short plain texts may follow a grammar by accident: both stay as they are found
    return ("wrong_extension", follows[0], follows) if follows else ("corrupt", None, follows)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))
    for batch in batches:
        languages = [language_of(p) for p in batch["path"]]
        found = [verdict(t, x) if t is not None and x else (None, None, None) for t, x in zip(batch["text"], languages, strict=True)]
        yield pd.DataFrame({"repo": batch["repo"], "path": batch["path"], "language": languages, "verdict": [f[0] for f in found], "parses_as": [f[1] for f in found], "follows": [f[2] for f in found]})


def judged(documents: DataFrame) -> DataFrame:
    """``repo, path, language, verdict, parses_as, follows`` for each source file with a text and an extension that stands for a language.

    Empty and blank texts are valid in all languages. A null text or an unknown extension is not judged and gives no row. Whole texts are parsed, whatever their length; a text nested
    deeper than the parser of its language can follow is a class of its own, ``too_deep``, and no broken file. One row per input row, no shuffle.
    """
    files = documents.where((F.col("source") == "repo_file") & F.col("path").isNotNull() & F.col("text").isNotNull()).select("repo", "path", "text")
    return files.mapInPandas(_judge, JUDGED).where("verdict IS NOT NULL")


def broken(documents: DataFrame) -> DataFrame:
    """``repo, path`` of the files that break the grammar of their extension's language."""
    return judged(documents).where("verdict IN ('wrong_extension', 'corrupt')").select("repo", "path")


def rates(documents: DataFrame, file_parse: DataFrame) -> DataFrame:
    """Per repository and language: files judged, broken ones, their share, wrong extensions, files nested too deep to be judged, good files that follow a foreign grammar as well, and how many of the broken and of the good files have an Error diagnostic on record."""
    errors = F.coalesce(F.exists("diagnostics", lambda x: x["severity"] == "Error"), F.lit(False))
    records = current_records(file_parse, errors.alias("said"))
    j, r = judged(documents).alias("j"), records.alias("r")
    both = j.join(r, F.col("j.repo").eqNullSafe(F.col("r.repo")) & (F.col("j.path") == F.col("r.path")), "left").select("j.*", F.coalesce("r.said", F.lit(False)).alias("said"))
    bad, good = F.col("verdict").isin("wrong_extension", "corrupt"), F.col("verdict") == "ok"
    return both.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(bad).alias("n_broken"), F.round(F.avg(bad.cast("double")), 6).alias("share"), F.count_if(F.col("verdict") == "wrong_extension").alias("n_wrong_extension"),
        F.count_if(F.col("verdict") == "too_deep").alias("n_too_deep"), F.count_if(good & (F.size("follows") > 1)).alias("n_good_foreign"), F.count_if(bad & F.col("said")).alias("n_broken_diagnosed"), F.count_if(good & F.col("said")).alias("n_good_diagnosed"),
    )
