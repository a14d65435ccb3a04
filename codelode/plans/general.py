"""Queries p1 and p6 (changes between snapshots, change feed) with their SQL twins."""

from __future__ import annotations

from codelode.common import table
from codelode.operators import change_log, snapshot_diff

QUERIES = {
    "p1_found": lambda s, d: snapshot_diff.snapshot_changes(table(s, d, "file_snapshots")),
    "p1_totals": lambda s, d: snapshot_diff.change_totals(snapshot_diff.snapshot_changes(table(s, d, "file_snapshots"))),
    "p6_found": lambda s, d: change_log.replayed(table(s, d, "change_events")),
    "p6_tombstones": lambda s, d: change_log.change_log(table(s, d, "change_events")).merged().where("not alive").select("repo", "path", "seq"),
}

_CHANGES = """
WITH held AS (
  SELECT repo, snapshot_no, path, max_by(coalesce('=' || lower(content_hash), ''), received_at) AS digest
  FROM file_snapshots WHERE snapshot_no IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
listing AS (SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS before_no FROM (SELECT DISTINCT repo, snapshot_no FROM held)),
pairs AS (SELECT * FROM listing WHERE before_no IS NOT NULL),
now_rows AS (SELECT h.repo, p.snapshot_no, h.path, h.digest FROM held h JOIN pairs p ON h.repo IS NOT DISTINCT FROM p.repo AND h.snapshot_no = p.snapshot_no),
old_rows AS (SELECT h.repo, p.snapshot_no, h.path, h.digest FROM held h JOIN pairs p ON h.repo IS NOT DISTINCT FROM p.repo AND h.snapshot_no = p.before_no),
changes AS (
  SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.path, o.path) AS path,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM now_rows n FULL JOIN old_rows o ON n.repo IS NOT DISTINCT FROM o.repo AND n.snapshot_no = o.snapshot_no AND n.path = o.path
  WHERE n.digest IS DISTINCT FROM o.digest)
"""
_FEED = r"""
WITH feed AS (
  SELECT repo, regexp_replace(replace(coalesce(path, CASE WHEN lower(trim(event)) = 'updated' THEN ir.path END), '\', '/'), '^(\./+)+', '') AS path, seq, arrival_no,
    lower(trim(event)) = 'updated' AS alive, CASE WHEN lower(trim(event)) = 'updated' THEN ir.content_hash END AS content_hash
  FROM change_events WHERE lower(trim(event)) IN ('updated', 'deleted') AND seq IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY seq DESC, arrival_no DESC) AS k FROM feed WHERE path IS NOT NULL)
"""

ORACLE = {
    "p1_found": _CHANGES + "SELECT repo, snapshot_no, path, change_kind FROM changes",
    "p1_totals": _CHANGES
    + "SELECT repo, snapshot_no, " + ", ".join(f"count(*) FILTER (change_kind = '{k}') AS n_{k}" for k in ("added", "removed", "changed")) + " FROM changes GROUP BY ALL",
    "p6_found": _FEED + "SELECT repo, path, content_hash FROM ranked WHERE k = 1 AND alive",
    "p6_tombstones": _FEED + "SELECT repo, path, seq FROM ranked WHERE k = 1 AND NOT alive",
}
