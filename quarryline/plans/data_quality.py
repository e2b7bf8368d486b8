"""Queries p2 and p5: drifting schemas and orphan references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.operators import orphans as O
from quarryline.operators import schema_drift as D
from quarryline.session import checkpointed
from quarryline.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    steps = D.migration_steps(table(spark, d, "artifacts"), table(spark, d, "artifact_records"))
    return steps.select("artifact_id", "change", "old_field", "new_field").distinct()


def p2_steps(spark: SparkSession, d: str) -> DataFrame:
    return D.migration_steps(table(spark, d, "artifacts"), table(spark, d, "artifact_records"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    a, r = table(spark, d, "artifacts"), table(spark, d, "artifact_records")
    seen = checkpointed(D.cells(r))
    return D.consistent_table(a, r, D.migration_steps(a, r, seen), seen)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ["imports", "parse_warnings", "artifacts", "snapshots", "source_files", "repos"]
    return O.orphans(*[table(spark, d, n) for n in names])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "status").distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_counts(_orphans(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_steps": p2_steps, "p2_table": p2_table, "p5_found": p5_found, "p5_counts": p5_counts,
}


def _norm(e: str) -> str:
    """A path with one spelling, in SQL: eight folders at most are climbed."""
    step = r"(^|/)(?:[^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\./"
    out = f"regexp_replace(regexp_replace(replace(replace({e}, chr(92), '/'), '/./', '/'), '/+', '/', 'g'), '^(\\./)+', '')"
    for _ in range(8):
        out = f"regexp_replace({out}, '{step}', '\\1')"
    return f"ltrim({out}, '/')"


_SUFFIXES = "(VALUES ('')" + "".join(f", ('{s}')" for s in O.SUFFIXES + O.INDEXES) + ") AS s(suffix)"

_P5 = f"""WITH f AS (SELECT snapshot_id, {_norm('path')} AS path, min(arrived_at) AS starts, CASE WHEN count(deleted_at) = count(*) THEN max(deleted_at) END AS ends FROM source_files GROUP BY 1, 2),
i AS (SELECT DISTINCT import_id, snapshot_id, from_path, raw, resolved, reason_code, observed_at FROM imports),
n AS (SELECT import_id, snapshot_id, observed_at, {_norm("regexp_extract(replace(from_path, chr(92), '/'), '^(.*)/[^/]*$', 1) || '/' || raw")} AS base FROM i WHERE resolved IS NULL AND starts_with(raw, '.') AND coalesce(reason_code, '') <> 'dynamic-import'),
h AS (SELECT n.import_id, f.starts, f.ends FROM n, {_SUFFIXES} JOIN f ON f.snapshot_id = n.snapshot_id AND f.path = n.base || s.suffix),
snaps AS (SELECT snapshot_id, min(created_at) AS starts FROM snapshots GROUP BY 1),
r AS (SELECT 'imports' AS ref_table, CAST(i.import_id AS VARCHAR) AS ref_id, i.observed_at AS t, f.path IS NOT NULL AS found, f.starts, f.ends FROM i LEFT JOIN f ON f.snapshot_id = i.snapshot_id AND f.path = {_norm('i.resolved')} WHERE i.resolved IS NOT NULL
 UNION ALL SELECT 'imports', CAST(n.import_id AS VARCHAR), n.observed_at, h.import_id IS NOT NULL, h.starts, h.ends FROM n LEFT JOIN h ON h.import_id = n.import_id
 UNION ALL SELECT 'parse_warnings', CAST(w.warning_id AS VARCHAR), w.created_at, f.path IS NOT NULL, f.starts, f.ends FROM (SELECT DISTINCT warning_id, snapshot_id, file, created_at FROM parse_warnings WHERE file IS NOT NULL) w LEFT JOIN f ON f.snapshot_id = w.snapshot_id AND f.path = {_norm('w.file')}
 UNION ALL SELECT 'artifacts', a.artifact_id, a.created_at, p.snapshot_id IS NOT NULL, p.starts, NULL FROM (SELECT DISTINCT artifact_id, snapshot_id, created_at FROM artifacts) a LEFT JOIN snaps p ON p.snapshot_id = a.snapshot_id
 UNION ALL SELECT 'snapshots', s.snapshot_id, s.created_at, q.repo_id IS NOT NULL, NULL, NULL FROM (SELECT DISTINCT snapshot_id, repo_id, created_at FROM snapshots) s LEFT JOIN repos q ON q.repo_id = s.repo_id),
o AS (SELECT ref_table, ref_id, t, CASE WHEN NOT found THEN 'missing' WHEN starts > t THEN 'late' WHEN ends <= t THEN 'deleted' END AS status FROM r)
"""

_P2 = """WITH rec AS (SELECT DISTINCT artifact_id, payload FROM artifact_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
k AS (SELECT artifact_id, payload, json_extract_string(payload, '$.path') AS path, unnest(json_keys(payload)) AS field FROM rec),
c AS (SELECT artifact_id, path, field, json_extract(payload, '$."' || field || '"') AS v FROM k),
t AS (SELECT artifact_id, path, field, CAST(v AS VARCHAR) AS value, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS type FROM c),
f AS (SELECT artifact_id, field, max(type) AS type FROM t GROUP BY 1, 2),
a AS (SELECT DISTINCT artifact_id, snapshot_id, kind, version FROM artifacts),
p AS (SELECT artifact_id, lag(artifact_id) OVER (PARTITION BY snapshot_id, kind ORDER BY version, artifact_id) AS prev_id FROM a),
gone AS (SELECT p.artifact_id, p.prev_id, o.field FROM p JOIN f o ON o.artifact_id = p.prev_id WHERE NOT EXISTS (SELECT 1 FROM f n WHERE n.artifact_id = p.artifact_id AND n.field = o.field)),
come AS (SELECT p.artifact_id, n.field FROM p JOIN f n ON n.artifact_id = p.artifact_id WHERE p.prev_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f o WHERE o.artifact_id = p.prev_id AND o.field = n.field)),
m AS (SELECT g.artifact_id, g.field AS old_field, k.field AS new_field FROM gone g JOIN come k ON k.artifact_id = g.artifact_id JOIN t x ON x.artifact_id = g.prev_id AND x.field = g.field AND x.type IS NOT NULL JOIN t y ON y.artifact_id = k.artifact_id AND y.field = k.field AND y.type IS NOT NULL AND y.path = x.path GROUP BY 1, 2, 3 HAVING bool_and(x.value = y.value))"""
_P2_STEPS = """SELECT artifact_id, 'renamed' AS change, old_field, new_field FROM m
UNION SELECT artifact_id, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.artifact_id = g.artifact_id AND m.old_field = g.field)
UNION SELECT artifact_id, 'added', '', field FROM come g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.artifact_id = g.artifact_id AND m.new_field = g.field)
UNION SELECT p.artifact_id, 'retyped', n.field, n.field FROM p JOIN f n ON n.artifact_id = p.artifact_id JOIN f o ON o.artifact_id = p.prev_id AND o.field = n.field WHERE n.type <> o.type"""

SQL: dict[str, str] = {
    "p2_found": _P2 + " " + _P2_STEPS,
    "p2_steps": _P2 + f", s AS ({_P2_STEPS}) SELECT s.*, o.type AS old_type, n.type AS new_type FROM s JOIN p ON p.artifact_id = s.artifact_id LEFT JOIN f o ON o.artifact_id = p.prev_id AND o.field = s.old_field LEFT JOIN f n ON n.artifact_id = s.artifact_id AND n.field = s.new_field",
    "p5_found": _P5 + "SELECT DISTINCT ref_table, ref_id, status FROM o WHERE status IS NOT NULL",
    "p5_counts": _P5 + "SELECT ref_table, strftime(t, '%Y-%m') AS month, status, count(*) AS n FROM (SELECT DISTINCT * FROM o WHERE status IS NOT NULL) GROUP BY 1, 2, 3",
}
