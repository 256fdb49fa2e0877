"""Queries about successive deliveries."""

from __future__ import annotations

from ..operators.snapshots import snapshot_changes
from ..sources.tables import table
from .registry import query

_PATH = r"regexp_replace(regexp_replace(trim(path), '[\\/]+', '/', 'g'), '^(\.?/)+', '')"
_SQL = rf"""
WITH listed AS (SELECT repo, snapshot_id, lag(snapshot_id) OVER w AS prev_id, lead(snapshot_id) OVER w AS next_id
                FROM (SELECT DISTINCT repo, snapshot_id FROM snapshots) WINDOW w AS (PARTITION BY repo ORDER BY snapshot_id)),
f AS (SELECT repo, snapshot_id, {_PATH} AS path, nullif(regexp_extract(lower(content_hash), '[0-9a-f]{{64}}'), '') AS h, indexed_at FROM files),
newest AS (SELECT repo, snapshot_id, path, h FROM f QUALIFY row_number() OVER (PARTITION BY repo, snapshot_id, path ORDER BY indexed_at DESC, h DESC NULLS LAST) = 1),
v AS (SELECT n.*, l.prev_id, l.next_id FROM newest n JOIN listed l USING (repo, snapshot_id))
SELECT a.snapshot_id, a.path, CASE WHEN b.path IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM v a LEFT JOIN v b ON a.repo = b.repo AND a.path = b.path AND a.prev_id = b.snapshot_id
WHERE a.prev_id IS NOT NULL AND (b.path IS NULL OR a.h <> b.h)
UNION ALL
SELECT a.next_id AS snapshot_id, a.path, 'removed' FROM v a
WHERE a.next_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v b WHERE a.repo = b.repo AND a.path = b.path AND b.snapshot_id = a.next_id)
"""


@query(_SQL)
def p4_found(spark, d):
    return snapshot_changes(table(spark, d, "files"), table(spark, d, "snapshots")).select("snapshot_id", "path", "change_kind")
