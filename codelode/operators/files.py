"""File-level operators: size gate, skipped rows, languages, line counts, caps, module documentation, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import language_name, language_of_path

#: Largest file that is parsed; most symbols, calls, imports and diagnostics of a record.
MOST_BYTES, MOST_SYMBOLS, MOST_CALLS, MOST_IMPORTS, MOST_DIAGNOSTICS = 4 * 1024 * 1024, 4096, 8192, 2048, 64


def split_by_size(files: DataFrame, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): a file of exactly the limit is kept, a null size counts as 0."""
    size = F.coalesce("byte_len", F.lit(0))
    return files.where(size <= most), files.where(size > most)


def skipped_rows(skipped: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Records of files that were not parsed: no language, one warning."""
    message = F.concat(F.lit("file skipped: "), F.coalesce("byte_len", F.lit(0)), F.lit(f" bytes exceeds {most}"))
    return skipped.select("repo", "path", F.lit("unknown").alias("language"), F.lit(0).cast("bigint").alias("n_symbols"), F.lit("Warning").alias("severity"), message.alias("message"))


def of_languages(files: DataFrame, names: list[str]) -> DataFrame:
    """Files of the named languages by extension; names in any spelling, unknown names don't count, none left means all."""
    known = {"rust": "Rust", "rs": "Rust", "typescript": "TypeScript", "ts": "TypeScript", "javascript": "JavaScript", "js": "JavaScript", "python": "Python", "py": "Python"}
    wanted = sorted({known[n.strip().lower()] for n in names if n.strip().lower() in known}) or sorted(set(known.values()))
    return files.withColumn("language_by_path", language_of_path(F.col("path"))).where(F.col("language_by_path").isin(wanted))


def line_counts(texts: DataFrame) -> DataFrame:
    """``repo, path, code_lines, comment_lines, blank_lines, total_lines`` from the text: a line is a comment if a comment begins at its first sign or it lies inside a block comment that began so; blank if it has only white space.

    Block comments are followed by a fold over the lines of one text. What follows the last line break is a line, too; an empty text counts nothing.
    """
    kind = language_of_path(F.col("path"))
    start = F.struct(F.lit(0).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("comment"), F.lit(0).cast("bigint").alias("blank"), F.lit(False).alias("inside"))

    def fold(got: Column, line: Column) -> Column:
        bare = F.trim(F.translate(line, "\t\r\f\v", "    "))
        python = kind == "Python"
        opens = ~python & F.startswith(bare, F.lit("/*"))
        single = F.when(python, F.startswith(bare, F.lit("#"))).otherwise(F.startswith(bare, F.lit("//")))
        comment = got["inside"] | opens | single
        closes = bare.contains("*/")
        blank = (bare == "") & ~got["inside"]
        one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
        return F.struct(
            (got["code"] + one(~comment & ~blank)).alias("code"), (got["comment"] + one(comment & ~blank)).alias("comment"), (got["blank"] + one(blank)).alias("blank"),
            ((got["inside"] | opens) & ~closes).alias("inside"),
        )

    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    rows = texts.where(F.col("text").isNotNull()).select("repo", "path", F.aggregate(lines, start, fold).alias("m"), F.size(lines).cast("bigint").alias("total_lines"))
    return rows.select("repo", "path", F.col("m.code").alias("code_lines"), F.col("m.comment").alias("comment_lines"), F.col("m.blank").alias("blank_lines"), "total_lines")


def sizes(texts: DataFrame) -> DataFrame:
    """``repo, path, byte_len, line_count, digest``: bytes, line breaks plus one, and a hash that is equal for equal texts."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return texts.where(F.col("text").isNotNull()).select("repo", "path", F.octet_length("text").cast("bigint").alias("byte_len"), (breaks + 1).cast("bigint").alias("line_count"), F.sha2("text", 256).alias("digest"))


def capped(files: DataFrame, symbols: int = MOST_SYMBOLS, calls: int = MOST_CALLS, imports: int = MOST_IMPORTS, diagnostics: int = MOST_DIAGNOSTICS) -> DataFrame:
    """Cuts overlong lists of a record; each cut adds a warning, which takes the last place if the diagnostics are full."""
    said = F.coalesce("diagnostics", F.array().cast(files.schema["diagnostics"].dataType))
    out = files
    for name, most in (("symbols", symbols), ("calls", calls), ("imports", imports)):
        n = F.size(F.coalesce(F.col(name), F.array()))
        warning = F.struct(F.lit("Warning").alias("severity"), F.concat(F.lit(f"{name} truncated: "), n, F.lit(f" exceeds {most}")).alias("message"), F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("array<bigint>").alias("byte_span"))
        said = F.when(n > most, F.concat(F.slice(said, 1, diagnostics - 1), F.array(warning))).otherwise(said)
    out = out.withColumn("diagnostics", said)
    for name, most in (("symbols", symbols), ("calls", calls), ("imports", imports)):
        out = out.withColumn(name, F.slice(name, 1, most))
    return out


def module_docs(texts: DataFrame) -> DataFrame:
    """``repo, path, docstring``: the documentation at a file's head: ``//!`` lines, else ``///`` (Rust); a ``/** */`` block, else ``//`` lines (scripts); the first string (Python). After shebang, blank and, in Python, comment lines; null if there is none."""
    kind = language_of_path(F.col("path"))
    text = F.regexp_replace("text", "\r\n", "\n")
    head = F.regexp_replace(text, r"^(?:#!(?!\[)[^\n]*\n)?\s*", "")
    marked = lambda mark: F.array_join(F.transform(F.split(F.regexp_extract(head, rf"^((?:[ \t]*{mark}[^\n]*(?:\n|$))+)", 1), "\n"), lambda x: F.trim(F.regexp_replace(x, rf"^[ \t]*{mark}", ""))), "\n")
    lines = lambda mark: F.nullif(F.trim(F.regexp_replace(marked(mark), r"\n+$", "")), F.lit(""))
    block = F.regexp_extract(head, r"(?s)^/\*\*(.*?)\*/", 1)
    tidy = F.nullif(F.trim(F.array_join(F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*?", ""))), lambda x: x != ""), "\n")), F.lit(""))
    python = F.regexp_replace(head, r"^(?:[ \t]*#[^\n]*\n|\s*\n)*", "")
    quoted = F.coalesce(F.nullif(F.regexp_extract(python, r'(?s)^"""(.*?)"""', 1), F.lit("")), F.nullif(F.regexp_extract(python, r"(?s)^'''(.*?)'''", 1), F.lit("")))
    doc = F.when(kind == "Rust", F.coalesce(lines("//!"), lines("///"))).when(kind == "Python", F.trim(quoted)).otherwise(F.coalesce(tidy, lines("//")))
    return texts.where(F.col("text").isNotNull()).select("repo", "path", doc.alias("docstring"))


def totals(files: DataFrame) -> DataFrame:
    """Per repository: files, symbols, calls."""
    n = lambda c: F.sum(F.size(F.coalesce(F.col(c), F.array()))).alias(f"n_{c}")
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), n("symbols"), n("calls"))


def invalid(files: DataFrame, least: int = 1, most: int = 5) -> DataFrame:
    """``repo, path, problem``: one row per rule that a record breaks: version out of range, empty names, spans that end before they begin, calls of unknown callers, another number of cards than of symbols."""
    s, c = F.coalesce("symbols", F.array()), F.coalesce("calls", F.array())
    keys = F.transform(s, lambda x: x["local_key"])
    rules = (
        ("version", ~F.coalesce(F.col("ir_version").between(least, most), F.lit(False))),
        ("empty name", F.exists(s, lambda x: F.coalesce(x["name"] == "", F.lit(True)) | F.coalesce(x["qualified_name"] == "", F.lit(True)))),
        ("span", F.exists(s, lambda x: F.coalesce(x["end_line"] < x["start_line"], F.lit(False)))),
        ("unknown caller", F.exists(c, lambda x: ~F.coalesce(F.array_contains(keys, x["caller_local_key"]), F.lit(False)))),
        ("cards", F.size(s) != F.size(F.coalesce("symbol_cards", F.array()))),
    )
    problems = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules]))
    return files.select("repo", "path", F.explode(problems).alias("problem"))


def fingerprints(files: DataFrame) -> DataFrame:
    """``repo, path, fingerprint``: a hash of where a file's calls and imports lead, in order; equal fingerprints mean that no edge has changed."""
    call = F.transform(F.coalesce("calls", F.array()), lambda c: F.concat_ws("|", c["callee_name"], F.coalesce(c["callee_local_key"], F.lit("-")), F.coalesce(c["callee_file"], F.lit("-")), F.coalesce(c["callee_external"].cast("string"), F.lit("-"))))
    imported = F.transform(F.coalesce("imports", F.array()), lambda i: F.concat_ws("|", i["target_module"], F.coalesce(i["resolved"], F.lit("-"))))
    return files.select("repo", "path", F.sha2(F.concat_ws("\n", F.array_join(call, ";"), F.array_join(imported, ";")), 256).alias("fingerprint"))


def source_fingerprints(files: DataFrame, versions: str, packages: str = "") -> DataFrame:
    """``repo, fingerprint``: 16 hex digits over tool versions, packages and the bytes of all source files (``repo, path, text``) in order of their paths.

    Each file is hashed by itself, then each of 256 groups of paths, then the groups in order: no list grows with the files of a repository beyond a 256th of them. Null paths are no files, a null text counts as empty.
    """
    one = files.where(F.col("path").isNotNull()).select("repo", F.substring(F.sha2("path", 256), 1, 2).alias("part"), "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    listed = lambda a, b: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda x: F.concat_ws("\x1f", x[a], x[b])), "\x1e")
    parts = one.groupBy("repo", "part").agg(F.sha2(listed("path", "h"), 256).alias("h"))
    return parts.groupBy("repo").agg(F.substring(F.sha2(F.concat_ws("\x1d", F.lit(versions), F.lit(packages), listed("part", "h")), 256), 1, 16).alias("fingerprint"))
