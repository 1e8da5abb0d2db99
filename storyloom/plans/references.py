"""Queries on references to missing records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.functions.text import KEY_FORM_SQL
from storyloom.operators.references import Reference, dangling_references, dangling_report
from storyloom.sources.tables import table


def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("mentions", "kb_events", "entities", "chapters", "kb_deletions")}
    references = [
        Reference("mentions", "entity_id", t["mentions"], "entities", "created_at"),
        Reference("mentions", "chapter_id", t["mentions"], "chapters", "created_at"),
        Reference("kb_events", "chapter_id", t["kb_events"], "chapters", "created_at"),
        Reference("entities", "first_chapter_id", t["entities"], "chapters", "updated_at"),
    ]
    return dangling_references(references, {n: (t[n], "id", "arrived_at") for n in ("entities", "chapters")}, t["kb_deletions"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dangling(spark, sf_dir).select("ref_table", "ref_field", "record_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dangling_report(_dangling(spark, sf_dir))


_K = KEY_FORM_SQL.format
_FOUND = f"""
WITH refs AS (
  SELECT 'mentions' AS ref_table, 'entity_id' AS ref_field, id AS record_id, {_K('entity_id')} AS k, arrived_at, created_at AS made, 'entities' AS target FROM mentions
  UNION ALL SELECT 'mentions', 'chapter_id', id, {_K('chapter_id')}, arrived_at, created_at, 'chapters' FROM mentions
  UNION ALL SELECT 'kb_events', 'chapter_id', id, {_K('chapter_id')}, arrived_at, created_at, 'chapters' FROM kb_events
  UNION ALL SELECT 'entities', 'first_chapter_id', id, {_K('first_chapter_id')}, arrived_at, updated_at, 'chapters' FROM entities),
records AS (SELECT ref_table, ref_field, record_id, k, target, made, min(arrived_at) AS arrived FROM refs WHERE k IS NOT NULL GROUP BY ALL),
parents AS (
  SELECT 'entities' AS target, {_K('id')} AS k, min(arrived_at) AS arrived FROM entities GROUP BY ALL
  UNION ALL SELECT 'chapters', {_K('id')}, min(arrived_at) FROM chapters GROUP BY ALL),
entries AS (SELECT table_name AS target, {_K('record_id')} AS k, action, row_number() OVER (PARTITION BY table_name, {_K('record_id')} ORDER BY logged_at DESC, id DESC) AS n FROM kb_deletions),
found AS (
  SELECT DISTINCT r.ref_table, r.ref_field, r.record_id, r.made,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN e.action = 'delete' THEN 'deleted' ELSE 'late' END AS reason
  FROM records r LEFT JOIN parents p ON p.target = r.target AND p.k = r.k
  LEFT JOIN entries e ON e.target = r.target AND e.k = r.k AND e.n = 1
  WHERE p.k IS NULL OR e.action = 'delete' OR p.arrived > r.arrived)
"""
SQL = {
    "p1_found": _FOUND + "SELECT DISTINCT ref_table, ref_field, record_id FROM found",
    "p1_report": _FOUND + "SELECT ref_table, ref_field, strftime(TIMESTAMP '1970-01-01' + to_seconds(made), '%Y-%m') AS month, reason, count(*) AS refs FROM found GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (p1_found, p1_report)}
