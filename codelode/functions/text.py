"""Scalar functions as column expressions: identifiers, paths, sizes. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between two words of an identifier or text: anything but letters and digits, a rise from lower to upper case, the end of a run of capitals.
_WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}]+|(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase}\p{IsUppercase})(?=\p{IsLowercase})"

# Rank of a symbol kind in cards, and callee names that say nothing.
KIND_ORDER = "Function Method Struct Enum Trait Class Interface Module Namespace TypeAlias Constant Variable Macro".split()
NOISE = (
    "unwrap clone into to_string ok some none push map and_then or_else unwrap_or unwrap_or_else expect as_ref as_mut iter collect len is_empty new default from try_from try_into"
).split()


def tokenize(text: Column | str) -> Column:
    """Lower-case words of a text, repeats kept; null gives null. A run of capitals keeps its first lower-case letter's word apart only after the run (``XMLHttp``: ``xmlh``, ``ttp``)."""
    # the words are joined and split again so that lower case is taken once per text, without a lambda per word
    return F.array_remove(F.split(F.lower(F.array_join(F.split(text, _WORD_BREAK), "\x01")), "\x01"), "")


def norm_query(query: Column | str) -> Column:
    """A query in the form that is compared: lower case, words (underscores included) joined by one blank."""
    return F.array_join(F.filter(F.split(F.lower(query), r"[^\p{IsAlphabetic}\p{N}_]+"), lambda w: w != ""), " ")


def est_tokens(text: Column | str) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def last_segment(name: Column) -> Column:
    """After the last ``::``."""
    return F.element_at(F.split(name, "::"), -1)


def bare_name(callee: Column) -> Column:
    """The name that a call expression most likely means: before the first bracket, after the last ``::``; null for field chains and empty names."""
    head = F.substring_index(callee, "(", 1)
    last = last_segment(head)
    return F.when(head.contains("::"), F.when(last != "", last)).when(head.contains(".") | (head == ""), None).otherwise(head)


def module_prefix(name: Column) -> Column:
    """Before the last ``::``; null if there is none."""
    return F.when(name.contains("::"), F.regexp_extract(name, r"^(?s)(.*)::", 1))


def normalized_path(path: Column) -> Column:
    """A path without ``.``, ``..`` (never above the root) and doubled slashes."""
    parts = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda kept, p: F.when((p == "") | (p == "."), kept).when(p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p))),
    )
    return F.array_join(parts, "/")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def kind_rank(kind: Column) -> Column:
    """Place of a symbol kind in KIND_ORDER; unknown kinds last."""
    known = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), kind)
    return F.when(known > 0, known - 1).otherwise(len(KIND_ORDER))


def is_noise(callee: Column) -> Column:
    return last_segment(callee).isin(NOISE)


def fitted_lines(lines: Column, most_bytes: int) -> Column:
    """Whole lines from the top while text, line and a line break fit into ``most_bytes``; the first is always kept, none after the first that doesn't fit."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    def add(got: Column, line: Column) -> Column:  # noqa: E306
        over = F.octet_length(got["text"]) + F.octet_length(line) + 1 > most_bytes
        stop = got["full"] | (over & (got["text"] != ""))
        longer = F.when(got["text"] == "", line).otherwise(F.concat(got["text"], F.lit("\n"), line))
        return F.struct(F.when(stop, got["text"]).otherwise(longer).alias("text"), stop.alias("full"))

    return F.aggregate(lines, start, add)["text"]


def language_of_path(path: Column) -> Column:
    """Language of a path's extension; null for others."""
    ends = lambda *suffixes: F.expr("false") if not suffixes else _any([F.endswith(path, F.lit(s)) for s in suffixes])
    return F.when(ends(".rs"), "Rust").when(ends(".ts", ".tsx"), "TypeScript").when(ends(".js", ".jsx", ".mjs", ".cjs"), "JavaScript").when(ends(".py", ".pyi"), "Python")


def language_name(name: Column) -> Column:
    """One spelling per language; null for names that stand for none."""
    n = F.lower(F.trim(name))
    return F.when(n.isin("rust", "rs"), "Rust").when(n.isin("typescript", "ts"), "TypeScript").when(n.isin("javascript", "js"), "JavaScript").when(n.isin("python", "py"), "Python")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


#: Bytes of a message that are decoded.
MOST_MESSAGE_BYTES = 64 * 1024


def bounded_text(raw: Column) -> Column:
    """The first MOST_MESSAGE_BYTES bytes as text; what is no UTF-8, a letter cut at the end included, becomes replacement characters. Only for tools' messages, never for texts that are data."""
    return F.make_valid_utf8(F.substring(raw, 1, MOST_MESSAGE_BYTES).cast("string"))
