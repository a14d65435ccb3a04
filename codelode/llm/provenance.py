"""Generated, minified, vendored and data files among source files.

Token streams of all files (comments dropped, literals normalised) are fingerprinted by winnowing; a file most of whose fingerprints recur in several unrelated repositories is a vendored
copy. A header or folder that claims a copy is a weak voter: with it two repositories are enough. Headers, paths and the shape of the text tell what fingerprints cannot:
machine-made files, minified scripts, data saved as code, and copies that say so but have no second copy in the collection.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.common import current_records, written

#: Tokens of a fingerprinted window; windows of which one is chosen; fingerprints below which a file is compared as a whole instead.
GRAM, WINNOW, LEAST_PRINTS = 24, 20, 6
#: Repositories in which a fingerprint must occur to be recurrent (fewer where the file itself claims to be a copy), and the share of recurrent fingerprints that makes a copy.
LEAST_REPOS, CLAIMED_REPOS, COPY_SHARE = 3, 2, 0.6
#: Names that a window must hold; one of literals and signs alone, as in number arrays, is the same in all such files.
LEAST_NAMES = 4
#: A fingerprint in more files than this is joined by broadcast; there are at most (all fingerprints / HOT_FILES) of them, and never more than MOST_HOT.
HOT_FILES, MOST_HOT = 2000, 20_000

# Folders and name parts that tools give to what they write or bring in.
VENDOR_DIRS = "node_modules bower_components vendor vendored _vendor third_party thirdparty third-party 3rdparty external extern deps site-packages Pods".split()
MADE_DIRS = "generated __generated__ gen autogen dist".split()
_VENDOR_PATH = re.compile(rf"(?:^|/)(?:{'|'.join(re.escape(d) for d in VENDOR_DIRS)})/")
_MADE_PATH = re.compile(rf"(?:^|/)(?:{'|'.join(MADE_DIRS)})/|[._](?:generated|gen|g|pb|pb2|pb2_grpc|autogen|designer)\.\w+$|\.pb\.\w+$|_generated\.\w+$")
_MINIFIED_PATH = re.compile(r"[.-]min\.\w+$|\.bundle\.\w+$|\.[0-9a-f]{8,}\.[jt]s$")
# What tools and copiers write into headers.
_MADE_HEADER = re.compile(
    r"@generated\b|<auto-?generated\b|\b(?:code |file |this file (?:is|was) )?(?:auto(?:matically)?[- ]?)?generated (?:by|from|with|automatically|file|code)\b|\bautogenerated (?:from|by|file|code)\b|\b(?:automatically|machine)[- ](?:generated|made|written)\b"
    r"|\bdo not (?:edit|modify)\b|\bproduced by \S+ from\b|\bchanges (?:are|will be) (?:overwritten|lost)\b|\bmanual changes will be\b|\bedit the \w+ instead\b", re.I,
)
_BY_HAND = re.compile(r"\b(?:written|maintained|edited) by hand\b|\bhand[- ]?written\b|\bmethod stub\b|\bnot generated\b", re.I)
_COPIED_HEADER = re.compile(
    r"\bvendored\b|\b(?:bundled|imported) (?:third[- ]party|from)\b|\btaken over from\b|\bcopied (?:unchanged|verbatim|over)? ?from\b|\bmirror of \S+|\bupstream (?:revision|version|at)\b|\bfix bugs upstream\b|\bthird[- ]party code\b|\bthis file is part of \w+"
    r"|\breleased to the public domain by\b|\blicensed under the terms\b|\bcopyright \(c\) the \w+ authors\b|\ball rights reserved by its original authors\b|\bSPDX-License-Identifier\b|\bfile list in \w+|\b\S+ distribution, file list\b|\blocal edits: ", re.I,
)

_COMMENT_LINE = re.compile(r"[ \t]*(?://|#(?!\[)|/?\*|\"\"\"|<!--)")
_STRIPPED = re.compile(r"/\*.*?\*/|//[^\n]*|(?m:^[ \t]*#(?![!\[])[^\n]*)", re.S)
_TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\.){2,}\'|\d[\w.]*|[^\W\d]\w*|[^\w\s]')
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w])")
_COUNTED = re.compile(r"\d{1,18}")
_WORDY = re.compile(r"[^\W\d_]{2,}")


def fingerprints(text: str) -> np.ndarray:
    """Winnowed hashes of GRAM-token windows: of any WINNOW neighbouring windows at least one is chosen, unless none of them holds LEAST_NAMES names."""
    tokens = _TOKEN.findall(_STRIPPED.sub(" ", text))
    n = len(tokens) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    known: dict[str, int] = {}
    ids = np.empty(len(tokens), np.uint64)
    names = np.zeros(len(tokens) + 1, np.int64)
    for k, t in enumerate(tokens):
        i = known.get(t)
        if i is None:
            i = known[t] = 7 if t[0] in "\"'`" else 11 if t[0].isdigit() else zlib.crc32(t.encode("utf-8", "surrogatepass")) + 64 + ((1 << 40) if t[0] == "_" or t[0].isalpha() else 0)
        ids[k] = i
    np.cumsum(ids >> np.uint64(40), out=names[1:], dtype=np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    h[names[GRAM:] - names[:-GRAM] < LEAST_NAMES] = none
    if n > WINNOW:
        # minimum of each run of WINNOW windows, by halves
        low, width = h, 1
        while width * 2 <= WINNOW:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = WINNOW - width
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        h = low
    else:
        h = h.min(keepdims=True)
    h = np.unique(h)
    return (h[:-1] if len(h) and h[-1] == none else h).astype(np.int64)


# Names under which any project defines something, and signs of a body that does something.
_ENTRY_NAMES = {"main", "new", "default", "setup", "teardown", "setUp", "tearDown", "constructor", "__init__", "handler", "run", "test", "tests"}
_DEFINED = re.compile(r"\b(?:def|fn|function|class|struct|enum|trait|interface|impl)\s*\*?\s+(\w+)|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>")
_DOES = {"return", "yield", "await", "raise", "throw", "assert", "if", "for", "while", "match", "=", ".", "+", "*", "/", "%"}


def whole_print(text: str) -> int | None:
    """One hash of all tokens, literals normalised. None for boilerplate, which recurs by itself: pages, listings, imports and constants, entry points, definitions without a body."""
    code = _STRIPPED.sub(" ", text).strip()
    if code.startswith(("<", "{", "[")):
        return None
    tokens = _TOKEN.findall(code)
    names = {a or b for a, b in _DEFINED.findall(_STRING.sub('""', code))} - _ENTRY_NAMES
    if not names or _DOES.isdisjoint(tokens):
        return None
    same = "\0".join("7" if t[0] in "\"'`" else "11" if t[0].isdigit() else t for t in tokens)
    return int.from_bytes(hashlib.blake2b(same.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def header(text: str) -> str:
    """Comment lines before the first code, a doc comment or shebang included; of a file that starts with code nothing."""
    out, inside = [], ""
    for line in text.split("\n"):
        bare = line.strip()
        if inside:
            out.append(bare)
            if inside in bare:
                inside = ""
        elif not bare:
            continue
        elif bare.startswith(('"""', "'''")):
            out.append(bare)
            inside = "" if bare.count(bare[:3]) > 1 else bare[:3]
        elif bare.startswith("/*"):
            out.append(bare)
            inside = "" if "*/" in bare else "*/"
        elif _COMMENT_LINE.match(line):
            out.append(bare)
        else:
            break
    return "\n".join(out)


def closing(text: str) -> str:
    """Comment lines after the last code; of a file that ends with code nothing."""
    out, inside = [], False
    lines = text.split("\n")
    for k in range(len(lines) - 1, -1, -1):
        bare = lines[k].strip()
        if not inside and bare.endswith("*/") and not bare.startswith("//"):
            inside = True
        if inside:
            start = bare.rfind("/*")
            if start > 0:  # code stands before it
                out.append(bare[start:])
                break
            out.append(bare)
            inside = start < 0
        elif bare.endswith("-->") and bare.startswith("<!--") or bare.startswith(("//", "#")) and not bare.startswith(("#[", "#!")):
            out.append(bare)
        elif bare:
            break
    return "\n".join(reversed(out))


def is_data(text: str) -> bool:
    """Nearly all of the code is numbers, or blobs: long strings without words."""
    code = _STRIPPED.sub("", text)
    blob = prose = 0
    for m in _STRING.finditer(code):
        s = m.group()
        if len(s) >= 80 and " " not in s:
            blob += len(s)
        else:
            prose += len(s)
    rest = _STRING.sub("", code)
    numbers = sum(len(m) for m in _NUMBER.findall(rest))
    solid = sum(1 for c in rest if not c.isspace() and c not in ",;[]{}()&")
    total = solid + blob + prose
    return total > 0 and (numbers + blob) / total > 0.7


def is_minified(text: str) -> bool:
    """Most of the code stands on very long lines with hardly any blanks. Long text in strings does not count."""
    code = _STRING.sub('""', _STRIPPED.sub("", text))
    lines = code.split("\n")
    dense = sum(len(line) for line in lines if len(line) > 400 and line.count(" ") < 0.12 * len(line))
    return dense > 400 and dense > 0.6 * sum(len(line) for line in lines)


def is_counted(text: str) -> bool:
    """Most lines are a few shapes that differ in a running number and its company: the mark of a code-writing loop."""
    code = _STRIPPED.sub("", text).strip()
    if code.startswith(("{", "[")):  # a configuration or listing under a wrong extension, not a program's output
        return False
    lines = [line.strip() for line in code.split("\n") if line.strip()]
    shapes: dict[str, set[str]] = {}
    of = Counter()
    for line in lines:
        numbers = _COUNTED.findall(line)
        if numbers:
            shape = _STRING.sub('"', _COUNTED.sub("0", re.sub(r'"[a-z]+"', '"', line)))
            shapes.setdefault(shape, set()).add(numbers[0])
            of[shape] += 1
    # the first number of a shape's lines counts up: as many different ones as lines, from a small start, without gaps
    counted = blocks = 0
    for shape, n in of.items():
        firsts = shapes[shape]
        if n >= 5 and len(firsts) == n and max(map(int, firsts)) - min(map(int, firsts)) == n - 1:
            counted += n
            blocks = max(blocks, n)
    return counted > 0.6 * len(lines) or (blocks >= 8 and counted + _followers(lines) > 0.75 * len(lines))


def _followers(lines: list[str]) -> int:
    """Lines that repeat exactly many times, such as the bodies and closings between counted ones."""
    return sum(n for line, n in Counter(lines).items() if n >= 8)


def kind_by_text(path: str, text: str | None, byte_len: float | None = None, line_count: float | None = None) -> str | None:
    """``vendored``, ``generated``, ``minified`` or ``data`` as far as one file tells; None for what looks hand-written, and for an empty file.

    Without a text only the path and the recorded sizes speak.
    """
    if text is not None and not text.strip():
        return None
    if text is None and byte_len is not None and byte_len == 0:
        return None
    if _VENDOR_PATH.search(path):
        return "vendored"
    if _MINIFIED_PATH.search(path):
        return "minified"
    if _MADE_PATH.search(path):
        return "generated"
    if text is None:
        known = byte_len is not None and line_count is not None and byte_len == byte_len and line_count == line_count
        return "minified" if known and byte_len > 800 and byte_len / max(1.0, line_count) > 400 else None
    for line in f"{header(text)}\n{closing(text)}".split("\n"):
        if _BY_HAND.search(line):
            continue
        if _MADE_HEADER.search(line):
            return "generated"
        if _COPIED_HEADER.search(line):
            return "vendored"
    if is_data(text):
        return "data"
    if is_minified(text):
        return "minified"
    return "generated" if is_counted(text) else None


LOOKED = "repo STRING, path STRING, kind STRING, prints ARRAY<BIGINT>, exact BOOLEAN"


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kinds, prints, exact = [], [], []
        for path, text, size, lines in zip(batch["path"], batch["text"], batch["byte_len"], batch["line_count"], strict=True):
            kinds.append(kind_by_text(path, text, size, lines))
            found = fingerprints(text) if text and not text.isspace() else []
            short = len(found) < LEAST_PRINTS
            if short:
                whole = whole_print(text) if text and not text.isspace() else None
                found = [] if whole is None else [whole]
            prints.append(found)
            exact.append(short)
        yield pd.DataFrame({"repo": batch["repo"], "path": batch["path"], "kind": kinds, "prints": prints, "exact": exact})


def source_files(documents: DataFrame, file_parse: DataFrame) -> DataFrame:
    """``repo, path, text, byte_len, line_count``: source files with the sizes of their current record; a file without record has null sizes."""
    sizes = current_records(file_parse, "byte_len", "line_count")
    texts = documents.where((F.col("source") == "repo_file") & F.col("path").isNotNull()).select("repo", "path", "text")
    t, s = texts.alias("t"), sizes.alias("s")
    return t.join(s, F.col("t.repo").eqNullSafe(F.col("s.repo")) & (F.col("t.path") == F.col("s.path")), "left").select("t.repo", "t.path", "t.text", "s.byte_len", "s.line_count")


def recurrent(prints: DataFrame, least_repos: int = CLAIMED_REPOS) -> DataFrame:
    """``print, repos, files`` of the fingerprints that occur in at least ``least_repos`` repositories. A null repository counts as none."""
    per_repo = prints.groupBy("print", "repo").agg(F.count(F.lit(1)).alias("files"))
    return per_repo.groupBy("print").agg(F.count("repo").alias("repos"), F.sum("files").alias("files")).where(F.col("repos") >= least_repos).select("print", "repos", "files")


def not_handwritten(files: DataFrame) -> DataFrame:
    """``repo, path, kind, evidence`` of the files of ``source_files`` that were not written by hand in their repository.

    ``kind`` is ``vendored``, ``generated``, ``minified`` or ``data``. ``evidence`` is ``fingerprints`` where the file's fingerprints recur in enough repositories: that makes a copy of every file that
    bears no mark of a program, minifier or data. It is ``marks`` where header, path or shape decide, including a file that claims to be a copy without a second one in the collection.
    Files with fewer than LEAST_PRINTS fingerprints are compared by one hash of all their tokens instead, which must recur in as many repositories: among so few, parts of boilerplate recur by themselves.
    Empty and blank files are never cases. Files without text are judged by path and recorded sizes. One row per input row at most; very long texts are read whole.

    Each fingerprint occurs in a set of repositories, counted by an aggregate with map-side combine. Fingerprints in very many files come back by broadcast (at most MOST_HOT of
    them), the rest by shuffle.
    """
    looked = written(files.mapInPandas(_look, LOOKED).withColumn("file", F.monotonically_increasing_id()), "provenance")
    prints = looked.where(F.size("prints") > 0).select("file", "repo", F.explode("prints").alias("print"))
    often = written(recurrent(prints), "recurrent-prints")
    hot = F.broadcast(often.where(F.col("files") > HOT_FILES).orderBy(F.desc("files"), "print").limit(MOST_HOT).select("print", F.col("repos").alias("hot_repos")))
    split = prints.select("file", "print").join(hot, "print", "left")
    rest = often.join(hot, "print", "left_anti").select("print", "repos")
    hits = split.where("hot_repos IS NOT NULL").select("file", F.col("hot_repos").alias("repos")).unionByName(split.where("hot_repos IS NULL").join(rest, "print").select("file", "repos"))
    shares = hits.groupBy("file").agg(F.count_if(F.col("repos") >= LEAST_REPOS).alias("many"), F.count(F.lit(1)).alias("some"))
    judged = looked.select("file", "repo", "path", "kind", F.size("prints").alias("n"), "exact").join(shares, "file", "left")
    least = F.col("n") * F.lit(COPY_SHARE)
    copy = F.coalesce((F.col("many") >= least) | ((F.col("kind") == "vendored") & (F.col("some") >= least)), F.lit(False)) & F.coalesce(F.col("kind") == "vendored", F.lit(True))
    return judged.where(copy | F.col("kind").isNotNull()).select("repo", "path", F.when(copy, "vendored").otherwise(F.col("kind")).alias("kind"), F.when(copy, "fingerprints").otherwise("marks").alias("evidence"))


def evidence_totals(cases: DataFrame) -> DataFrame:
    """Files per ``kind`` and ``evidence``."""
    return cases.groupBy("kind", "evidence").agg(F.count(F.lit(1)).alias("n_files"))
