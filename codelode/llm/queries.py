"""Queries of the training-data operators, pN_..., and the SQL twins of those that SQL can express."""

from __future__ import annotations

from codelode.common import table
from codelode.llm import abuse, function_docs, leakage, packing, provenance, syntax, term_weight, value_counts

QUERIES = {
    "p2_found": lambda s, d: syntax.broken(table(s, d, "documents")),
    "p2_rates": lambda s, d: syntax.rates(table(s, d, "documents"), table(s, d, "file_parse")),
    "p3_found": lambda s, d: term_weight.leading_terms(term_weight.term_scores(table(s, d, "search_units"), table(s, d, "probe_units"))),
    "p3_scores": lambda s, d: term_weight.term_scores(table(s, d, "search_units")),
    "p4_found": lambda s, d: provenance.not_handwritten(provenance.source_files(table(s, d, "documents"), table(s, d, "file_parse"))).select("repo", "path"),
    "p4_kinds": lambda s, d: provenance.not_handwritten(provenance.source_files(table(s, d, "documents"), table(s, d, "file_parse"))),
    "p4_evidence": lambda s, d: provenance.evidence_totals(provenance.not_handwritten(provenance.source_files(table(s, d, "documents"), table(s, d, "file_parse")))),
    "p5_found": lambda s, d: function_docs.documented_functions(table(s, d, "documents"), table(s, d, "file_parse")).select("repo", "path", "qualified_name"),
    "p5_pairs": lambda s, d: function_docs.documented_functions(table(s, d, "documents"), table(s, d, "file_parse")),
    "p7_found": lambda s, d: value_counts.callee_counts(table(s, d, "file_parse")).where("mark IS NOT NULL").select("callee_name", "mark"),
    "p7_counts": lambda s, d: value_counts.callee_counts(table(s, d, "file_parse")),
    "p8_containers": lambda s, d: packing.packed(table(s, d, "documents"), table(s, d, "context_windows")),
    "p8_unused": lambda s, d: packing.unused(packing.packed(table(s, d, "documents"), table(s, d, "context_windows")), table(s, d, "context_windows")),
    "p9_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id"),
    "p9_report": lambda s, d: leakage.leak_report(leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")), table(s, d, "eval_items")),
    "p10_found": lambda s, d: abuse.abuse_scores(table(s, d, "documents")).where("score >= 0.5").select("doc_id"),
    "p10_scores": lambda s, d: abuse.abuse_scores(table(s, d, "documents")),
    "p10_rates": lambda s, d: abuse.abuse_rates(abuse.abuse_scores(table(s, d, "documents"))),
}

_SCORES = """
WITH once AS (
  SELECT unit_id, terms FROM (SELECT unit_id, list_filter(terms, lambda t: t IS NOT NULL AND t <> '') AS terms FROM search_units WHERE unit_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY coalesce(len(terms), 0) DESC, terms DESC) = 1),
unit AS (SELECT unit_id, terms, len(terms) AS n FROM once WHERE len(terms) > 0),
whole AS (SELECT count(*)::DOUBLE AS units, avg(n) AS mean_length FROM unit),
pairs AS (SELECT unit_id, n, term, count(*) AS tf FROM (SELECT unit_id, n, unnest(terms) AS term FROM unit) GROUP BY ALL),
total AS (SELECT term, sum(tf) AS cf FROM pairs GROUP BY term),
tfns AS (SELECT unit_id, term, tf, tf * log2(1 + mean_length / n) AS tfn, cf / units AS rate FROM pairs JOIN total USING (term), whole),
scores AS (SELECT unit_id, term, tf, round((log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (tfn + 1), 9) AS score FROM tfns)
"""
_COUNTS = r"""
WITH cur AS (SELECT repo, path, calls FROM file_parse WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY parsed_at DESC NULLS LAST, received_at DESC NULLS LAST) = 1),
named AS (SELECT repo, path, regexp_replace(c.callee_name, '^[\s\x0B\p{Z}]+|[\s\x0B\p{Z}]+$', '', 'g') AS callee_name FROM (SELECT repo, path, unnest(calls) AS c FROM cur)),
counts AS (SELECT callee_name, count(*) AS occurrences, count(DISTINCT (repo, path)) AS files FROM named WHERE callee_name <> '' GROUP BY callee_name),
marks AS (SELECT *, CASE WHEN files < 3 THEN 'rare' WHEN files > 0.1 * (SELECT count(*) FROM cur) THEN 'common' END AS mark FROM counts)
"""

ORACLE = {
    "p3_found": _SCORES + "SELECT unit_id, term FROM scores WHERE unit_id IN (SELECT unit_id FROM probe_units) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, tf DESC, term) = 1",
    "p3_scores": _SCORES + "SELECT unit_id, term, tf, score FROM scores",
    "p7_found": _COUNTS + "SELECT callee_name, mark FROM marks WHERE mark IS NOT NULL",
    "p7_counts": _COUNTS + "SELECT callee_name, occurrences, files, mark FROM marks",
}
