"""Configuration files of TypeScript projects: discovery, inheritance, and the alias maps that result."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.common import written
from codelode.functions.text import directory, normalized_path

#: Files in a chain of inheritance, the first included.
MOST_LEVELS = 10

_OPTIONS = "repo STRING, path STRING, base_url STRING, paths MAP<STRING, ARRAY<STRING>>, extends STRING"
CONFIG = "repo STRING, dir STRING, base_url STRING, paths MAP<STRING, ARRAY<STRING>>"


def _texts_of(value: Any) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def options_of(text: str) -> tuple[str | None, dict[str, list[str]] | None, str | None] | None:
    """(base URL, paths, extends) that one file declares, None for each that it doesn't; None altogether for a text that is no JSON object.

    Of a list to inherit from the first string counts. Paths keep the targets that are strings; a key without any is dropped.
    """
    try:
        whole = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(whole, dict):
        return None
    options = whole.get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    base, paths, extends = options.get("baseUrl"), options.get("paths"), whole.get("extends")
    kept = {k: _texts_of(v) for k, v in paths.items() if _texts_of(v)} if isinstance(paths, dict) else None
    return base.rstrip("/") if isinstance(base, str) else None, kept, extends if isinstance(extends, str) else next(iter(_texts_of(extends)), None)


def _declared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for repo, path, text in zip(batch["repo"], batch["path"], batch["text"], strict=True):
            told = options_of(text)
            if told is not None:
                out.append((repo, path, told[0], told[1], told[2]))
        yield pd.DataFrame(out, columns=["repo", "path", "base_url", "paths", "extends"])


def effective(files: DataFrame) -> DataFrame:
    """``repo, dir, base_url, paths`` of every ``tsconfig.json`` among ``repo, path, text`` rows that has paths, its own or inherited.

    A file inherits from the one that ``extends`` names, seen from its own folder (``.json`` is added where it is missing), over at most MOST_LEVELS files; the nearest declaration of each of base URL and paths holds as a
    whole. A base URL counts from the folder of the file that declares it; without one the folder of the file that declares the paths is the base. A base at the root is null. Files that
    are no JSON object end a chain, so does a name that no file has; a circle ends with the levels. Null paths and texts are no files. Several rows of one path: the least text holds.
    """
    named = files.where(F.col("path").isNotNull() & F.col("text").isNotNull() & F.col("path").endswith(".json"))
    once = named.groupBy("repo", "path").agg(F.min("text").alias("text"))
    told = written(once.mapInPandas(_declared, _OPTIONS), "config-options")
    base = told.select(F.col("repo").alias("_repo"), F.col("path").alias("_path"), F.col("base_url").alias("_base"), F.col("paths").alias("_paths"), F.col("extends").alias("_extends"))
    folder = directory(F.col("at"))
    follow = normalized_path(F.concat_ws("/", folder, F.when(F.col("extends").endswith(".json"), F.col("extends")).otherwise(F.concat("extends", F.lit(".json")))))
    rows = told.where((F.col("path") == "tsconfig.json") | F.col("path").endswith("/tsconfig.json")).select(
        "repo", directory(F.col("path")).alias("dir"), F.col("path").alias("at"), "base_url", F.when(F.col("base_url").isNotNull(), directory(F.col("path"))).alias("base_dir"), "paths", F.when(F.col("paths").isNotNull(), directory(F.col("path"))).alias("paths_dir"), "extends"
    )
    for _ in range(MOST_LEVELS - 1):
        if rows.where("extends IS NOT NULL").isEmpty():
            break
        next_ = rows.withColumn("at", F.when(F.col("extends").isNotNull(), follow)).join(base, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("at") == F.col("_path")), "left")
        near = directory(F.col("at"))
        rows = written(next_.select(
            "repo", "dir", "at", F.coalesce("base_url", "_base").alias("base_url"), F.coalesce("base_dir", F.when(F.col("_base").isNotNull(), near)).alias("base_dir"), F.coalesce("paths", "_paths").alias("paths"),
            F.coalesce("paths_dir", F.when(F.col("_paths").isNotNull(), near)).alias("paths_dir"), F.col("_extends").alias("extends"),
        ), "config-level")
    prefix = F.when(F.col("base_url").isNotNull(), normalized_path(F.concat_ws("/", "base_dir", "base_url"))).otherwise(F.col("paths_dir"))
    return rows.where("paths IS NOT NULL").select("repo", "dir", F.nullif(prefix, F.lit("")).alias("base_url"), "paths")
