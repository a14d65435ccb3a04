"""Retrieval cards: short texts about a file and about each of its symbols, as column expressions over one record (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import est_tokens, fitted_lines, is_noise, kind_rank, last_segment

#: Limits of a card: bytes of a file's and of a symbol's card; symbol lines, imports, callees of a file's card; callees and characters of documentation of a symbol's card.
FILE_BYTES, SYMBOL_BYTES, SYMBOL_LINES, IMPORTS, CALLEES, SYMBOL_CALLEES, DOC_CHARS = 2048, 512, 40, 24, 15, 10, 240


def _more(n: Column, most: int, form: str = "(+{} more)") -> Column:
    before, after = form.split("{}")
    return F.when(n > most, F.concat(F.lit(before), (n - most).cast("string"), F.lit(after)))


def call_histogram(calls: Column) -> Column:
    """``(name, n)`` structs of the callees' last segments without noise, most frequent first, then by name."""
    names = F.filter(F.transform(calls, lambda c: last_segment(c["callee_name"])), lambda n: n.isNotNull() & ~is_noise(n))
    counted = F.transform(F.array_distinct(names), lambda n: F.struct((-F.size(F.filter(names, lambda m: m == n))).alias("k"), n.alias("name")))
    return F.transform(F.array_sort(counted), lambda x: F.struct(x["name"].alias("name"), (-x["k"]).cast("bigint").alias("n")))


def file_card_lines(path: Column, language: Column, line_count: Column, content_hash: Column, imports: Column, symbols: Column, calls: Column) -> Column:
    modules = F.array_sort(F.array_distinct(F.transform(imports, lambda i: i["target_module"])))
    import_line = F.concat_ws(" ", F.concat(F.lit("IMPORTS "), F.array_join(F.slice(modules, 1, IMPORTS), ", ")), _more(F.size(modules), IMPORTS))
    ordered = F.array_sort(F.transform(symbols, lambda s, k: F.struct(kind_rank(s["kind"]).alias("rank"), s["qualified_name"].alias("q"), k.alias("k"), s.alias("s"))))
    symbol_lines = F.transform(F.slice(ordered, 1, SYMBOL_LINES), lambda o: F.concat(
        F.lit("  "), o["s"]["kind"], F.lit(" "), o["s"]["qualified_name"], F.lit(" L"), o["s"]["start_line"], F.lit("-"), o["s"]["end_line"],
        F.coalesce(F.concat(F.lit(" sig="), o["s"]["signature"]), F.lit("")),
    ))
    rest = _more(F.size(symbols), SYMBOL_LINES)
    histogram = call_histogram(calls)
    calls_line = F.concat(F.lit("CALLS_OUT "), F.array_join(F.transform(F.slice(histogram, 1, CALLEES), lambda h: F.concat(h["name"], F.lit("×"), h["n"])), " "))
    rest_calls = _more(F.size(histogram), CALLEES)
    public = F.transform(F.filter(symbols, lambda s: s["name"].rlike(r"^\p{Lu}")), lambda s: s["name"])
    none = F.array().cast("array<string>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    return F.concat(
        F.array(F.concat(F.lit("FILE path="), path, F.lit(" lang="), language, F.lit(" lines="), line_count, F.lit(" hash="), F.substring(content_hash, 1, 8))),
        F.when(F.size(imports) > 0, F.array(import_line)).otherwise(none),
        F.when(F.size(symbols) > 0, F.concat(F.array(F.lit("SYMBOLS")), symbol_lines, one(F.concat(F.lit("  "), rest)))).otherwise(none),
        F.when(F.size(histogram) > 0, F.concat(F.array(calls_line), one(F.concat(F.lit("  "), rest_calls)))).otherwise(none),
        F.when(F.size(public) > 0, F.array(F.concat(F.lit("PUB "), F.array_join(public, ", ")))).otherwise(none),
    )


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.array())


def _file_card() -> Column:
    """Card of a record as a struct; the estimate is of the whole text, the text is cut to whole lines."""
    lines = file_card_lines(F.col("path"), F.coalesce("language", F.lit("")), F.coalesce("line_count", F.lit(0)), F.coalesce("content_hash", F.lit("")), _empty("imports"), _empty("symbols"), _empty("calls"))
    whole = F.array_join(lines, "\n")
    text = F.when(F.octet_length(whole) > FILE_BYTES, fitted_lines(lines, FILE_BYTES)).otherwise(whole)
    return F.struct(F.lit(1).cast("bigint").alias("card_version"), est_tokens(whole).alias("est_tokens"), text.alias("text"))


def _symbol_card(s: Column, calls: Column) -> Column:
    """Card of a symbol as a struct; the estimate is of the text as cut."""
    mine = F.filter(calls, lambda c: c["caller_local_key"] == s["local_key"])
    names = F.array_sort(F.array_distinct(F.filter(F.transform(mine, lambda c: c["callee_name"]), lambda n: n.isNotNull() & ~is_noise(n))))
    doc = F.substring(s["docstring"], 1, DOC_CHARS)
    calls_line = F.concat_ws(" ", F.concat(F.lit("CALLS "), F.array_join(F.slice(names, 1, SYMBOL_CALLEES), ", ")), _more(F.size(names), SYMBOL_CALLEES, "(+{})"))
    lines = F.array_compact(F.array(
        F.concat(F.lit("SYM path="), F.col("path"), F.lit(" qname="), s["qualified_name"], F.lit(" kind="), s["kind"], F.lit(" L"), s["start_line"], F.lit("-"), s["end_line"]),
        F.concat(F.lit("SIG "), s["signature"]), F.when(doc != "", F.concat(F.lit("DOC "), doc)), F.when(F.size(names) > 0, calls_line),
    ))
    whole = F.array_join(lines, "\n")
    text = F.when(F.octet_length(whole) > SYMBOL_BYTES, fitted_lines(lines, SYMBOL_BYTES)).otherwise(whole)
    return F.struct(F.lit(1).cast("bigint").alias("card_version"), est_tokens(text).alias("est_tokens"), text.alias("text"))


def file_cards(files: DataFrame) -> DataFrame:
    """``repo, path, card_version, est_tokens, text``. Null lists count as empty, a null language or hash as an empty word."""
    return files.select("repo", "path", _file_card().alias("card")).select("repo", "path", "card.*")


def symbol_cards(files: DataFrame) -> DataFrame:
    """``repo, path, sym_ord, card_version, est_tokens, text``: one card per symbol."""
    rows = files.select("repo", "path", _empty("calls").alias("calls"), F.posexplode("symbols").alias("sym_ord", "s"))
    return rows.select("repo", "path", F.col("sym_ord").cast("bigint").alias("sym_ord"), _symbol_card(F.col("s"), F.col("calls")).alias("card")).select("repo", "path", "sym_ord", "card.*")


def with_cards(records: DataFrame) -> DataFrame:
    """Records with fresh cards, as many symbol cards as symbols."""
    calls = _empty("calls")
    return records.withColumn("retrieval_card", _file_card()).withColumn("symbol_cards", F.transform(_empty("symbols"), lambda s: _symbol_card(s, calls)))
