"""Queries of the general problems: hierarchies (p2), references (p4), intervals (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.operators.hierarchy import descendants, hierarchy
from lexcorpus.operators.intervals import periods
from lexcorpus.operators.references import Reference, Target, orphan_counts, orphans
from lexcorpus.tables import table


def _hierarchy(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return hierarchy(table(spark, d, "legal_nodes"), newest=["updated_at"], paths=paths)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d, paths=False).select("node_id", "root_id", "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).select("node_id", F.concat_ws("/", "path").alias("path"), "depth", "root_id")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_hierarchy(spark, d))


def p2_endless(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d, paths=False).where("depth < 0").select("node_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cites, legacy = table(spark, d, "citation_entries"), table(spark, d, "legal_knowledge_documents")
    targets = [
        Target("legal_nodes", table(spark, d, "legal_nodes"), "id", "created_at"),
        Target("legal_document_versions", table(spark, d, "legal_document_versions"), "id", "created_at"),
        Target("legal_source_archives", table(spark, d, "legal_source_archives"), "id", "fetched_at"),
    ]
    references = [
        Reference("citation_entries", cites, "id", "legal_node_id", "legal_nodes", "created_at"),
        Reference("citation_entries", cites, "id", "document_version_id", "legal_document_versions", "created_at"),
        Reference("legal_knowledge_documents", legacy, "id", "archive_id", "legal_source_archives", "ingested_at"),
    ]
    return orphans(targets, references)


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "legal_document_versions").where(F.col("status").isin("PUBLISHED", "SUPERSEDED"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return periods(versions, "document_id", "effective_from", "effective_to").select(F.col("entity").alias("document_id"), "kind", text("start_at"), text("end_at"))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_endless, p4_found, p4_counts, p5_found)}

_WALK = """WITH RECURSIVE n AS (SELECT id, arg_max(parent_id, (updated_at, parent_id)) AS parent_id FROM legal_nodes GROUP BY id),
t AS (
  SELECT n.id, n.id AS root_id, CAST(0 AS BIGINT) AS depth, n.id AS path FROM n LEFT JOIN n p ON n.parent_id = p.id WHERE p.id IS NULL
  UNION ALL
  SELECT n.id, t.root_id, t.depth + 1, t.path || '/' || n.id FROM n JOIN t ON n.parent_id = t.id
),
r AS (SELECT n.id AS node_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1) AS depth, t.path FROM n LEFT JOIN t ON t.id = n.id)
"""

_REFS = """WITH k AS (
  SELECT 'legal_nodes' AS target, lower(trim(id)) AS key, min(created_at) AS arrived FROM legal_nodes GROUP BY ALL
  UNION ALL SELECT 'legal_document_versions', lower(trim(id)), min(created_at) FROM legal_document_versions GROUP BY ALL
  UNION ALL SELECT 'legal_source_archives', lower(trim(id)), min(fetched_at) FROM legal_source_archives GROUP BY ALL
),
c AS (
  SELECT 'citation_entries' AS table_name, id AS row_id, 'legal_node_id' AS field_name, 'legal_nodes' AS target, lower(trim(legal_node_id)) AS key, created_at AS seen_at FROM citation_entries
  UNION ALL SELECT 'citation_entries', id, 'document_version_id', 'legal_document_versions', lower(trim(document_version_id)), created_at FROM citation_entries
  UNION ALL SELECT 'legal_knowledge_documents', id, 'archive_id', 'legal_source_archives', lower(trim(archive_id)), ingested_at FROM legal_knowledge_documents
),
f AS (
  SELECT DISTINCT table_name, row_id, field_name, CASE WHEN k.key IS NULL THEN 'missing' ELSE 'late' END AS state, strftime(c.seen_at, '%Y-%m') AS period
  FROM c LEFT JOIN k USING (target, key) WHERE c.key <> '' AND (k.key IS NULL OR k.arrived > c.seen_at)
)
"""

ORACLE = {
    "p2_found": _WALK + "SELECT node_id, root_id, depth FROM r",
    "p2_paths": _WALK + "SELECT node_id, coalesce(path, '') AS path, depth, root_id FROM r",
    "p2_descendants": """WITH RECURSIVE n AS (SELECT id, arg_max(parent_id, (updated_at, parent_id)) AS parent_id FROM legal_nodes GROUP BY id),
t AS (
  SELECT n.id, [] :: VARCHAR[] AS up FROM n LEFT JOIN n p ON n.parent_id = p.id WHERE p.id IS NULL
  UNION ALL
  SELECT n.id, list_prepend(t.id, t.up) FROM n JOIN t ON n.parent_id = t.id
)
SELECT up[i] AS ancestor_id, id AS node_id, i AS distance FROM t, unnest(range(1, len(up) + 1)) AS u(i)""",
    "p2_endless": _WALK + "SELECT node_id FROM r WHERE depth < 0",
    "p4_found": _REFS + "SELECT * FROM f",
    "p4_counts": _REFS + "SELECT table_name, field_name, state, period, count(*) AS n_references FROM f GROUP BY ALL",
    "p5_found": """WITH v AS (
  SELECT DISTINCT document_id, effective_from AS s, effective_to AS e FROM legal_document_versions
  WHERE status IN ('PUBLISHED', 'SUPERSEDED') AND effective_from < effective_to
),
m AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + INTERVAL 1 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT document_id, k, min(s) AS s, max(e) AS e FROM g GROUP BY document_id, k),
b AS (SELECT document_id, lag(e) OVER (PARTITION BY document_id ORDER BY k) AS a, s AS b FROM p),
u AS (SELECT document_id, 'period' AS kind, s, e FROM p UNION ALL SELECT document_id, 'gap', a, b FROM b WHERE a IS NOT NULL)
SELECT document_id, kind, strftime(s, '%Y-%m-%d %H:%M:%S') AS start_at, strftime(e, '%Y-%m-%d %H:%M:%S') AS end_at FROM u""",
}
