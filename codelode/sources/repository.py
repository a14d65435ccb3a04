"""Source files of a checked-out repository as rows, with ignore rules, and parsing them into records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.common import slots
from codelode.functions.text import language_of_path
from codelode.operators.cards import with_cards
from codelode.operators.files import MOST_BYTES


def _glob(body: str) -> str:
    """An ignore pattern as a regular expression: a star stays inside a folder, two stars cross folders."""
    out, k = "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and "]" in body[k + 2 :]:
            e = body.index("]", k + 2)
            out, k = out + "[" + body[k + 1 : e].replace("\\", "\\\\").replace("!", "^", 1) + "]", e + 1
        else:
            k += body[k] == "\\" and k + 1 < len(body)
            out, k = out + re.escape(body[k]), k + 1
    return out


class Ignore:
    """Ignore files of a repository: ``(folder, lines)``; later rules win, deeper files after shallower, an ignored folder hides all below it. ``.git`` is always ignored."""

    def __init__(self, files: list[tuple[str, list[str]]]) -> None:
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []
        for folder, lines in sorted(files, key=lambda x: x[0].count("/") + bool(x[0])):
            for line in lines:
                line = line.rstrip("\r\n")
                line = line if line.endswith("\\ ") else line.rstrip(" ")
                if not line or line.startswith("#"):
                    continue
                negated, only_folder = line.startswith("!"), line.endswith("/")
                body = line[negated:].rstrip("/")
                anchored = "/" in body
                pattern = _glob(body.lstrip("/"))
                self.rules.append((folder, re.compile(("" if anchored else "(?:.*/)?") + pattern + r"\Z"), negated, only_folder))

    def _hit(self, path: str, folder: bool) -> bool:
        hit = False
        for base, pattern, negated, only_folder in self.rules:
            if only_folder and not folder or base and not path.startswith(base + "/"):
                continue
            if pattern.match(path[len(base) + 1 :] if base else path):
                hit = not negated
        return hit

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        if ".git" in parts:
            return True
        return any(self._hit("/".join(parts[:k]), k < len(parts)) for k in range(1, len(parts) + 1))


def listing(spark: SparkSession, root: str) -> list[tuple[str, int, str]]:
    """(path below ``root``, bytes, full path) of every file, ``.git`` left out; the file source of the engine would skip names that begin with a dot or an underscore."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(base).toString().rstrip("/") + "/"
    found, walk = [], fs.listFiles(base, True)
    while walk.hasNext():
        status = walk.next()
        full = status.getPath().toString()
        path = full.removeprefix(top)
        if not path.startswith(".git/") and "/.git/" not in path:
            found.append((path, status.getLen(), full))
    return found


def _read(full: str) -> bytes:
    from pyarrow import fs

    source, path = fs.FileSystem.from_uri(full) if "%" in full or " " not in full else (fs.LocalFileSystem(), re.sub(r"^file:/*", "/", full))
    with source.open_input_stream(path) as f:
        return f.read()


def scan(spark: SparkSession, root: str, languages: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``path, language, byte_len, text`` of the files to parse, ``path, language, byte_len`` of files above the size limit), by path.

    Extension, ignore rules and size are tested on the listing (paths and sizes only, on the driver as for any file source), before contents are read by the tasks. Bytes that are no UTF-8 become replacement characters.
    """
    every = listing(spark, root)
    rules = Ignore([(path.rpartition("/")[0], _read(full).decode(errors="replace").split("\n")) for path, _, full in every if path.rpartition("/")[2] == ".gitignore"])
    rows = spark.createDataFrame([(p, n, f) for p, n, f in every if not rules.ignored(p)], "path STRING, byte_len BIGINT, full STRING").withColumn("language", language_of_path(F.col("path"))).where("language IS NOT NULL")
    if languages:
        rows = rows.where(F.col("language").isin(languages))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "language": batch["language"], "byte_len": batch["byte_len"], "text": [_read(f).decode(errors="replace") for f in batch["full"]]})

    small = rows.where(F.col("byte_len") <= MOST_BYTES).repartition(max(2, slots(spark)), "path").mapInPandas(read, "path STRING, language STRING, byte_len BIGINT, text STRING")
    return small.orderBy("path"), rows.where(F.col("byte_len") > MOST_BYTES).select("path", "language", "byte_len").orderBy("path")


def parse(rows: DataFrame) -> DataFrame:
    """Records of ``path, text`` rows: parsed in Arrow batches; a text that can't be read at all gives an empty record with a diagnostic."""
    from codelode.schema import record
    from codelode.sources.extract import parse_text

    schema = record()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_text(p, t) for p, t in zip(batch["path"], batch["text"], strict=True)], columns=schema.names)

    return with_cards(rows.select("path", "text").mapInPandas(run, schema))
