"""Queries that parse source texts and keep the records fresh."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.common import shared_dir, table
from codelode.operators import tables
from codelode.plans.records import texts
from codelode.sources import jsonl, repository
from codelode.streaming import deltas


def parsed(s: SparkSession, d: str) -> DataFrame:
    """Records of all source texts, ``repo`` in front."""
    rows = texts(s, d).where("text IS NOT NULL").select(F.concat_ws("\x00", "repo", "path").alias("path"), "text")
    return repository.parse(rows).select(F.substring_index("path", "\x00", 1).alias("repo"), F.substring_index("path", "\x00", -1).alias("path"), *[c for c in jsonl.REQUIRED if c != "path"], "docstring")


def _incremental(s: SparkSession, d: str) -> DataFrame:
    """All files as a first state, then one batch: every file whose path hash ends in 0 is deleted, in 1 edited, in 2 delivered unchanged."""
    state = deltas.RecordState(s, f"{shared_dir(s)}/records-{uuid.uuid4().hex}", repository.parse)
    files = texts(s, d).where("text IS NOT NULL AND repo IS NOT NULL")
    state.snapshot(files)
    turn = F.pmod(F.xxhash64("path"), F.lit(10))
    edits = files.where(turn < 3).select("repo", "path", F.when(turn == 0, "remove").otherwise("modify").alias("kind"), (turn == 0).alias("deleted"), F.xxhash64("path").alias("seq"), F.when(turn == 1, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"))
    return state.apply(edits, 1).groupBy("event", "repo").agg(F.count(F.lit(1)).alias("n"), F.max("changed").alias("changed"))


def _jsonl(s: SparkSession, d: str) -> DataFrame:
    """Current records written as JSON lines, replaced once, and read again."""
    from codelode.plans.records import current

    path = f"{shared_dir(s)}/jsonl-{uuid.uuid4().hex}"
    rows = current(s, d).drop("repo")
    for _ in range(2):
        jsonl.replace(rows, path)
    return jsonl.read_records(s, path).select("path", "language", F.size("symbols").alias("n_symbols"), F.size("calls").alias("n_calls"), F.col("retrieval_card.est_tokens").alias("est_tokens"))


QUERIES = {
    "parse_symbols": lambda s, d: tables.symbols(parsed(s, d)).select("repo", "path", "sym_ord", "kind", "qualified_name", "start_line", "end_line", "signature", "is_test"),
    "parse_calls": lambda s, d: tables.calls(parsed(s, d)).select("repo", "path", "call_ord", "caller_local_key", "callee_name", "callee_local_key", "callee_external", "line"),
    "parse_imports": lambda s, d: tables.imports(parsed(s, d)).select("repo", "path", "imp_ord", "import_name", "target_module", "kind"),
    "parse_metrics": lambda s, d: parsed(s, d).select("repo", "path", "language", "byte_len", "line_count", "metrics.code_lines", "metrics.comment_lines", "metrics.blank_lines", F.size("diagnostics").alias("n_diagnostics")),
    "incremental_apply": _incremental,
    "jsonl_roundtrip": _jsonl,
}

ORACLE = {
    "jsonl_roundtrip": "WITH cur AS (SELECT * FROM file_parse WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY parsed_at DESC NULLS LAST, received_at DESC NULLS LAST) = 1) SELECT path, language, coalesce(len(symbols), -1)::INTEGER AS n_symbols, coalesce(len(calls), -1)::INTEGER AS n_calls, retrieval_card.est_tokens AS est_tokens FROM cur",
}
