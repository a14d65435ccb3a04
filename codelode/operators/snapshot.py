"""A repository in a given number of tokens: one line per file, cut by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.common import written
from codelode.functions.text import est_tokens

#: Version of the text; least and most budget; tokens kept for header and footer; names on a file's line.
VERSION, LEAST, MOST, RESERVED, NAMES = 1, 500, 8000, 48, 12
#: Name of the tool in header and footer.
TITLE = "codelode"


def entries(files: DataFrame) -> DataFrame:
    """``repo, path, line_count, n_symbols, bare_line, full_line``: tests and nameless symbols are left out; a file without symbols has equal lines."""
    names = F.transform(F.filter(F.coalesce("symbols", F.array()), lambda s: ~F.coalesce(s["is_test"], F.lit(False)) & (s["name"] != "")), lambda s: s["name"])
    rows = files.select("repo", "path", F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce(names, F.array().cast("array<string>")).alias("names"))
    bare = F.concat("path", F.lit(" "), "language", F.lit(" "), "line_count", F.lit("L"))
    shown = F.concat_ws(" ", F.array_join(F.slice("names", 1, NAMES), ", "), F.when(F.size("names") > NAMES, F.concat(F.lit("+"), F.size("names") - NAMES)))
    return rows.select("repo", "path", "line_count", F.size("names").cast("bigint").alias("n_symbols"), bare.alias("bare_line"), F.when(F.size("names") > 0, F.concat(bare, F.lit("  "), shown)).otherwise(bare).alias("full_line"))


def allocated(entries_: DataFrame, budget: int) -> DataFrame:
    """``repo, states`` with one struct (``path, state, line, ...``) per file that is shown: a fold over the files in order of priority (more symbols first, then path).

    The budget bounds what can be shown, hence what is folded: a line costs two tokens at least, so files beyond the first ``budget`` can't be shown; they are counted, not
    gathered. A repository's list is therefore never longer than the budget.
    """
    from pyspark.sql import Window

    budget = max(LEAST, min(MOST, budget))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n_symbols"), "path"))
    full, bare = est_tokens("full_line"), est_tokens("bare_line")
    rows = entries_.withColumn("place", place).withColumn("full_t", full).withColumn("bare_t", bare)
    item = F.struct("place", "path", "full_line", "bare_line", "full_t", "bare_t")
    # every line has at least three characters and costs a token; what comes after `budget` files can't fit any more
    lists = rows.groupBy("repo").agg(F.array_sort(F.collect_list(F.when(F.col("place") <= budget, item))).alias("items"), F.count(F.lit(1)).alias("n_files"), F.sum("line_count").alias("n_lines"), F.sum("n_symbols").alias("n_symbols"))
    start = F.struct(F.lit(RESERVED).cast("bigint").alias("used"), F.array().cast("array<string>").alias("states"))
    def fold(got: Column, e: Column) -> Column:  # noqa: E306
        takes_full = got["used"] + e["full_t"] <= budget
        takes_bare = got["used"] + e["bare_t"] <= budget
        used = got["used"] + F.when(takes_full, e["full_t"]).when(takes_bare, e["bare_t"]).otherwise(0)
        return F.struct(used.alias("used"), F.concat(got["states"], F.array(F.when(takes_full, "full").when(takes_bare, "bare").otherwise("omitted"))).alias("states"))

    return lists.withColumn("fold", F.aggregate("items", start, fold)).withColumn("states", F.col("fold.states"))


def _assembled(budget: int, title: str) -> tuple[Column, Column]:
    shown = F.filter(F.arrays_zip("items", "states"), lambda z: z["states"] != "omitted")
    lines = F.transform(F.array_sort(F.transform(shown, lambda z: F.struct(z["items"]["path"].alias("path"), F.when(z["states"] == "full", z["items"]["full_line"]).otherwise(z["items"]["bare_line"]).alias("line")))), lambda x: x["line"])
    n = F.size(shown)
    head = F.concat(F.lit(f"{title} snapshot v{VERSION}: "), n, F.lit(" files, "), "n_lines", F.lit(" lines, "), "n_symbols", F.lit(f" symbols (budget {budget} tokens)\n"))
    foot = F.when(F.col("n_files") > n, F.concat(F.lit("+ "), F.col("n_files") - n, F.lit(f' more files omitted (budget) — find them: {title} search "<query>"\n'))).otherwise("")
    return F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), foot), n.cast("bigint")


def rendered(files: DataFrame, budget: int = 2500, title: str = TITLE) -> DataFrame:
    """``repo, content, est_tokens, files, omitted, budget``: one text per repository, the same for any order of the input.

    If header and footer overrun what was kept for them, the file of lowest priority is degraded (full, bare, omitted) until the text fits; a fold over the states, from the end.
    """
    budget = max(LEAST, min(MOST, budget))
    rows = allocated(entries(files), budget)
    content, n = _assembled(budget, title)
    rows = rows.withColumn("content", content).withColumn("files", n)
    # every turn degrades one entry of each text that is too long; a text without entries is as short as it gets
    while True:
        for _ in range(4):
            over = est_tokens("content") > budget
            last = F.aggregate(F.sequence(F.lit(1), F.size("states")), F.lit(0), lambda got, k: F.when(F.element_at("states", k) != "omitted", k).otherwise(got))
            worse = F.transform("states", lambda s, k: F.when(k + 1 == last, F.when(s == "full", "bare").otherwise("omitted")).otherwise(s))
            rows = rows.withColumn("states", F.when(over & (F.size("states") > 0), worse).otherwise(F.col("states")))
            content, n = _assembled(budget, title)
            rows = rows.withColumn("content", content).withColumn("files", n)
        rows = written(rows, "snapshot-turn")
        if rows.where((est_tokens("content") > budget) & (F.col("files") > 0)).isEmpty():
            break
    return rows.select("repo", "content", est_tokens("content").alias("est_tokens"), "files", (F.col("n_files") - F.col("files")).alias("omitted"), F.lit(budget).cast("bigint").alias("budget"))


class Held:
    """A rendered text that is served unchanged until it has been idle for ``ttl_ms``. The clock is the caller's."""

    def __init__(self, content: str, paths: list[str], ttl_ms: int, now_ms: int) -> None:
        self.content, self.paths, self.ttl_ms, self.last_ms = content, paths, ttl_ms, now_ms

    def read(self, now_ms: int) -> str:
        self.last_ms = now_ms
        return self.content

    def is_idle_expired(self, now_ms: int) -> bool:
        return max(0, now_ms - self.last_ms) >= self.ttl_ms
