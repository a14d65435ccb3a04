"""The call graph: edges in three tiers, adjacency, callers and callees, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.common import written
from codelode.functions.text import bare_name, last_segment
from codelode.operators.tables import calls, symbols

NODE = ["repo", "path", "sym_ord"]


def nodes(files: DataFrame) -> DataFrame:
    """One row per symbol; ``node`` (path, then place in the file) gives the order of nodes inside a repository."""
    rows = symbols(files)
    return rows.select(*NODE, "local_key", "name", "qualified_name", "kind", "start_line", "end_line", F.struct("path", "sym_ord").alias("node"))


def first_wins(rows: DataFrame, keys: list[str], value: str = "node") -> DataFrame:
    """The lowest node per key: an aggregate with map-side combine."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value))


def unique_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The node of each key that exactly one node has."""
    return rows.groupBy(*keys).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def edges(files: DataFrame) -> DataFrame:
    """``repo, caller, callee, call_line, inferred, call_path, call_ord``: one row per call that leads to a node.

    Tiers: the callee's key in the same file; its qualified name in the file named by the call, else the only symbol of that bare name there; for calls that name neither, the only
    symbol of that bare name in the repository (``inferred``), whether or not the call is marked external. Calls by an unknown caller are dropped, ambiguous names give no edge. Equal keys in a file: the first symbol holds.
    """
    n, c = nodes(files), calls(files)
    local = first_wins(n, ["repo", "path", "local_key"])
    named = first_wins(n, ["repo", "path", "qualified_name"])
    bare_here = unique_wins(n, ["repo", "path", "name"])
    bare_any = unique_wins(n, ["repo", "name"])
    rows = c.select("repo", "path", "call_ord", "caller_local_key", "callee_name", "callee_local_key", "callee_file", F.col("line").alias("call_line"))
    rows = rows.join(local.select("repo", "path", F.col("local_key").alias("caller_local_key"), F.col("node").alias("caller")), ["repo", "path", "caller_local_key"])
    rows = rows.withColumn("wanted", F.when(F.col("callee_local_key").isNull() & F.col("callee_file").isNull(), bare_name(F.col("callee_name")))).withColumn("last", last_segment(F.col("callee_name")))
    in_file = rows.where("callee_local_key IS NOT NULL").join(local.select("repo", "path", F.col("local_key").alias("callee_local_key"), F.col("node").alias("callee")), ["repo", "path", "callee_local_key"])
    across = rows.where("callee_local_key IS NULL AND callee_file IS NOT NULL")
    across = across.join(named.select("repo", F.col("path").alias("callee_file"), F.col("qualified_name").alias("callee_name"), F.col("node").alias("exact")), ["repo", "callee_file", "callee_name"], "left")
    across = across.join(bare_here.select("repo", F.col("path").alias("callee_file"), F.col("name").alias("last"), F.col("node").alias("only")), ["repo", "callee_file", "last"], "left")
    across = across.withColumn("callee", F.coalesce("exact", "only")).where("callee IS NOT NULL")
    guessed = rows.where("wanted IS NOT NULL").join(bare_any.select("repo", F.col("name").alias("wanted"), F.col("node").alias("callee")), ["repo", "wanted"])
    out = ["repo", "caller", "callee", "call_line", "inferred", F.col("path").alias("call_path"), "call_ord"]
    tiers = [t.withColumn("inferred", F.lit(k == 2)).select(*out) for k, t in enumerate((in_file, across, guessed))]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2])


def adjacency(edges_: DataFrame) -> DataFrame:
    """One row per pair of nodes; line and ``inferred`` of its first call."""
    place = F.struct("call_path", "call_ord")
    return edges_.groupBy("repo", "caller", "callee").agg(F.min_by("call_line", place).alias("call_line"), F.min_by("inferred", place).alias("inferred"))


def lookup(nodes_: DataFrame, name: str) -> DataFrame:
    """Nodes whose name or qualified name is ``name``; several rows mean the name is ambiguous, none that it is unknown."""
    return nodes_.where((F.col("name") == name) | (F.col("qualified_name") == name))


def neighbours(nodes_: DataFrame, pairs: DataFrame, name: str, callers: bool) -> DataFrame:
    """Callers (or callees) of every node called ``name``: one group per matching node, in the order (other node, line)."""
    own, other = ("callee", "caller") if callers else ("caller", "callee")
    matches = lookup(nodes_, name).select("repo", F.col("node").alias(own), F.col("qualified_name").alias("of"))
    found = pairs.join(F.broadcast(matches), ["repo", own])
    names = nodes_.select("repo", F.col("node").alias(other), "qualified_name")
    rows = found.join(names, ["repo", other])
    return rows.select("repo", F.col(f"{own}.path").alias("of_path"), "of", F.col(f"{other}.path").alias("path"), "qualified_name", F.col("call_line").alias("line"), "inferred")


def reach(pairs: DataFrame, start: DataFrame, max_hops: int = 8) -> DataFrame:
    """Breadth-first search from the nodes in ``start`` (``repo, node``; one per repository): ``repo, node, hops, trail``.

    ``trail`` holds the walked nodes from the start to the node. Nodes of a level are discovered in the order of their parents and, below one parent, of the nodes: that is the order of the trails,
    so the smallest trail is the one found first, and no ranking of a whole level is needed. Levels are written to the shared folder, so that plans stay flat and a lost executor costs
    one level.
    """
    edge = pairs.select("repo", F.col("caller").alias("node"), F.col("callee").alias("next"))
    level = written(start.select("repo", "node", F.lit(0).cast("bigint").alias("hops"), F.array("node").alias("trail")), "reach-0")
    seen = level
    for hop in range(1, max_hops + 1):
        found = level.join(edge, ["repo", "node"]).groupBy("repo", "next").agg(F.min("trail").alias("trail"))
        fresh = found.withColumnRenamed("next", "node").join(seen.select("repo", "node"), ["repo", "node"], "left_anti")
        level = written(fresh.select("repo", "node", F.lit(hop).cast("bigint").alias("hops"), F.concat("trail", F.array("node")).alias("trail")), f"reach-{hop}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def shortest_path(pairs: DataFrame, repo: str, source: tuple[str, int], target: tuple[str, int], max_hops: int = 8) -> list[tuple[str, int]]:
    """The walked nodes from ``source`` to ``target``; one node if they are the same, empty if ``target`` is out of reach within ``max_hops``."""
    node = F.struct(F.lit(source[0]).alias("path"), F.lit(source[1]).cast("bigint").alias("sym_ord"))
    start = pairs.sparkSession.range(1).select(F.lit(repo).alias("repo"), node.alias("node"))
    found = reach(pairs.where(F.col("repo") == repo), start, max_hops).where((F.col("node.path") == target[0]) & (F.col("node.sym_ord") == target[1])).first()
    return [(n["path"], n["sym_ord"]) for n in found["trail"]] if found else []
