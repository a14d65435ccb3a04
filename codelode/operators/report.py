"""Text that people read: hits, edges and paths, one line each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.operators.graph import lookup


def hit_line(cards: bool = False) -> Column:
    """``score path:line kind name`` of a hit, the score rounded from its exact value to three digits, with ``cards`` its card below, indented. Nulls are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.replace(F.format_number("score", 3), F.lit(","), F.lit("")), F.lit(" "), text("path"), F.lit(":"), text("line"), F.lit(" "), text("kind"), F.lit(" "), text("name"))
    return F.concat(line, F.lit("\n  "), F.replace(text("card"), F.lit("\n"), F.lit("\n  "))) if cards else line


def edge_line(callers: bool) -> Column:
    """``path:line  name`` of a caller, or ``path:line  own name → name`` of a callee, as rows of ``graph.neighbours``; a guessed edge is marked."""
    mark = F.when(F.col("inferred"), F.lit("  (inferred)")).otherwise("")
    at = F.concat(F.lit("  "), F.col("path") if callers else F.col("of_path"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")), F.lit("  "))
    names = F.col("qualified_name") if callers else F.concat("of", F.lit(" → "), "qualified_name")
    return F.concat(at, names, mark)


def only_node(nodes: DataFrame, name: str) -> DataFrame:
    """The one node called ``name`` (name or qualified name); a name that no node or several nodes have is an error, never a guess."""
    found = lookup(nodes, name).select("repo", "node").distinct()
    some = found.limit(2).collect()
    if not some:
        raise LookupError(f"no matches for '{name}'")
    if len(some) > 1:
        raise LookupError(f"'{name}' is ambiguous ({found.count()} matches), use a qualified name")
    return found


def steps(reached: DataFrame, pairs: DataFrame) -> DataFrame:
    """``repo, node, step, caller, callee, call_line`` of rows of ``graph.reach``: the consecutive pairs of each trail, in order. A trail of one node has none."""
    both = reached.select("repo", "node", F.posexplode(F.transform(F.slice("trail", 2, 1_000_000), lambda x, k: F.struct(F.get("trail", k).alias("caller"), x.alias("callee")))).alias("step", "pair"))
    rows = both.select("repo", "node", (F.col("step") + 1).cast("bigint").alias("step"), "pair.caller", "pair.callee")
    return rows.join(pairs.select("repo", "caller", "callee", "call_line"), ["repo", "caller", "callee"], "left").select("repo", "node", "step", "caller", "callee", "call_line")


def path_text(steps_: DataFrame, nodes: DataFrame) -> DataFrame:
    """``repo, node, text``: head and one line per step, ``path:line  name → name``."""
    name = lambda side: nodes.select("repo", F.col("node").alias(side), F.col("qualified_name").alias(f"{side}_name"))
    rows = steps_.join(name("caller"), ["repo", "caller"]).join(name("callee"), ["repo", "callee"])
    line = F.concat(F.lit("  "), F.col("caller.path"), F.lit(":"), F.coalesce(F.col("call_line").cast("string"), F.lit("")), F.lit("  "), F.col("caller_name"), F.lit(" → "), F.col("callee_name"))
    lists = rows.groupBy("repo", "node").agg(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("path found ("), F.size("lines"), F.lit(" hops):\n"))
    return lists.select("repo", "node", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))
