"""Queries of publication, migration, version comparison and tree order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.functions import payload as P
from lexcorpus.operators import ingest as I
from lexcorpus.operators import publish as P2
from lexcorpus.operators.hierarchy import descendants, hierarchy
from lexcorpus.plans.corpus import _BLANK, _N
from lexcorpus.tables import table

NOW = "2026-01-01"


def publish_apply(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "legal_document_versions")
    last = v.groupBy("document_id").agg(F.max(F.struct("version_number", "id", "content_hash", "status")).alias("l"))
    hash_ = F.when(F.col("l.status") == "PUBLISHED", F.col("l.content_hash")).otherwise(F.sha2("l.content_hash", 256))
    incoming = last.select("document_id", hash_.alias("content_hash"), F.lit("reparsed").alias("parser_id"), F.lit("2025-01-01").cast("timestamp_ntz").alias("effective_from"))
    return P2.publish(v, incoming, NOW).drop("id")


def migrate_corpus(s: SparkSession, d: str) -> DataFrame:
    return P2.migrate(table(s, d, "legal_knowledge_documents"), table(s, d, "legal_knowledge_articles"), table(s, d, "legal_source_archives"), P.title_type(F.col("title")))


def _migrated(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return P2.migrated_rows(table(s, d, "legal_knowledge_documents"), table(s, d, "legal_knowledge_articles"), table(s, d, "legal_source_archives"), P.title_type(F.col("title")))


def migrate_nodes(s: SparkSession, d: str) -> DataFrame:
    return _migrated(s, d)["nodes"].select("id", "document_version_id", "parent_id", "node_type", "article", "source_locator", "content_hash")


def migrate_audit(s: SparkSession, d: str) -> DataFrame:
    rows = _migrated(s, d)
    kept = rows["documents"].join(rows["versions"].select(F.col("document_id").alias("id"), F.col("id").alias("version_id")), "id")
    return rows["audit"].join(kept.select("legacy_id", "version_id", "document_number"), "legacy_id", "left")


def migrate_reconcile(s: SparkSession, d: str) -> DataFrame:
    rows = _migrated(s, d)
    mapping = rows["documents"].select("legacy_id", F.col("id").alias("document_id")).join(rows["versions"].select("document_id", F.col("id").alias("document_version_id")), "document_id")
    # what became of the articles once every blank text was dropped and the numbers were tidied
    later = rows["nodes"].where("trim(text) <> ''").withColumn("article", F.trim(F.regexp_replace("article", "[^0-9]+$", ""))).withColumn("updated_at", F.lit(0))
    return I.reconcile_migration(table(s, d, "legal_knowledge_articles"), mapping, later)


def locator_changes(s: SparkSession, d: str) -> DataFrame:
    return P2.locator_changes(table(s, d, "legal_nodes"), table(s, d, "legal_document_versions"))


def tree_preorder(s: SparkSession, d: str) -> DataFrame:
    return P2.preorder(table(s, d, "legal_nodes"))


def cascade_closure(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "legal_nodes")
    withdrawn = table(s, d, "legal_document_versions").where("status = 'WITHDRAWN'").select(F.col("id").alias("document_version_id")).distinct()
    return P2.cascade(n, n.join(withdrawn, "document_version_id", "left_semi"))


def subtree_sizes(s: SparkSession, d: str) -> DataFrame:
    below = descendants(hierarchy(table(s, d, "legal_nodes"), newest=["updated_at"]))
    return below.groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("n_below"), F.max("distance").alias("height"))


def node_violations(s: SparkSession, d: str) -> DataFrame:
    return P2.node_violations(table(s, d, "legal_nodes"))


def latest_editions(s: SparkSession, d: str) -> DataFrame:
    return P2.latest_editions(table(s, d, "legal_knowledge_documents"))


QUERIES = {f.__name__: f for f in (publish_apply, migrate_corpus, migrate_nodes, migrate_audit, migrate_reconcile, locator_changes, tree_preorder, cascade_closure, subtree_sizes, node_violations, latest_editions)}

_PAIRS = """e AS (SELECT id, arg_max(parent_id, (updated_at, parent_id)) AS parent_id FROM legal_nodes GROUP BY id),
t AS (SELECT e.id, [] :: VARCHAR[] AS up FROM e LEFT JOIN e p ON e.parent_id = p.id WHERE p.id IS NULL UNION ALL SELECT e.id, list_prepend(t.id, t.up) FROM e JOIN t ON e.parent_id = t.id)"""

_MIGRATED = """k AS (SELECT id, unnest(arg_max(struct_pack(title, law_id, source_url, jurisdiction, content_sha256, archive_id), (ingested_at, title, law_id, source_url, jurisdiction, content_sha256, archive_id))) FROM legal_knowledge_documents WHERE id IS NOT NULL GROUP BY id),
b AS (SELECT id FROM legal_knowledge_documents GROUP BY id HAVING max(lower(trim(archive_id))) IN (SELECT lower(trim(id)) FROM legal_source_archives)),
m AS (SELECT k.* FROM k JOIN b USING (id)),
r AS (SELECT DISTINCT id, document_id, ord, 'article-' || coalesce(article_number, CAST(ord AS VARCHAR)) AS base FROM legal_knowledge_articles),
w AS (SELECT *, row_number() OVER (PARTITION BY document_id, base ORDER BY ord, id) AS i FROM r),
l AS (SELECT id, document_id, CASE WHEN i = 1 THEN base ELSE base || '__legacyId-' || id END AS source_locator FROM w),
x AS (SELECT id, unnest(arg_max(struct_pack(text, title, article_number), (text, title, article_number))) FROM legal_knowledge_articles GROUP BY id)"""

ORACLE = {
    "migrate_nodes": f"""WITH {_MIGRATED} SELECT sha256('r|' || id) AS id, sha256('v|' || id) AS document_version_id, NULL :: VARCHAR AS parent_id, 'DOCUMENT' AS node_type, NULL :: VARCHAR AS article, 'doc' AS source_locator, sha256(coalesce(title, '')) AS content_hash FROM m
UNION ALL SELECT sha256('n|' || l.document_id || '|' || l.id), sha256('v|' || l.document_id), sha256('r|' || l.document_id), 'ARTICLE', article_number, source_locator, sha256(coalesce(text, '')) FROM l JOIN x USING (id) WHERE l.document_id IN (SELECT id FROM m)""",
    "migrate_audit": f"""WITH {_MIGRATED}, o AS (SELECT DISTINCT id FROM legal_knowledge_documents) SELECT o.id AS legacy_id, CASE WHEN m.id IS NOT NULL THEN sha256('d|' || o.id) END AS entity_id, 'legacy_backfill' AS action, CASE WHEN m.id IS NOT NULL THEN 'migrated' ELSE 'no_matching_archive' END AS outcome,
  CASE WHEN m.id IS NOT NULL THEN sha256('v|' || o.id) END AS version_id, m.law_id AS document_number FROM o LEFT JOIN m USING (id)""",
    "migrate_reconcile": f"""WITH {_MIGRATED} SELECT l.id AS article_id, l.document_id, source_locator AS expected_locator, CASE WHEN m.id IS NULL THEN 'document_not_found' WHEN trim(coalesce(x.text, '')) = '' THEN 'missing'
  WHEN trim(regexp_replace(x.article_number, '[^0-9]+$', '')) IS DISTINCT FROM x.article_number THEN 'other_number' ELSE 'matched' END AS outcome FROM l JOIN x USING (id) LEFT JOIN m ON m.id = l.document_id""",
    "publish_apply": f"""WITH v AS (SELECT DISTINCT id, document_id, version_number, effective_from, effective_to, content_hash, parser_id, status FROM legal_document_versions),
l AS (SELECT document_id, max(version_number) AS top, arg_max(CASE WHEN status = 'PUBLISHED' THEN content_hash ELSE sha256(content_hash) END, (version_number, id)) AS h FROM v GROUP BY 1),
c AS (SELECT l.document_id, top, h, CASE WHEN bool_or(v.content_hash = h AND parser_id = 'reparsed') THEN 'unchanged' WHEN bool_or(v.content_hash = h) THEN 'canonicalization' ELSE 'source_update' END AS decision FROM l JOIN v USING (document_id) GROUP BY 1, 2, 3)
SELECT v.document_id, version_number, effective_from, CASE WHEN status = 'PUBLISHED' AND decision = 'source_update' THEN coalesce(effective_to, TIMESTAMP '{NOW}') ELSE effective_to END AS effective_to, content_hash, parser_id,
  CASE WHEN status = 'PUBLISHED' AND decision <> 'unchanged' THEN 'SUPERSEDED' ELSE status END AS status, 'kept' AS decision FROM v LEFT JOIN c USING (document_id)
UNION ALL SELECT document_id, top + 1, CASE WHEN decision <> 'canonicalization' THEN TIMESTAMP '2025-01-01' END, NULL, h, 'reparsed', 'PUBLISHED', decision FROM c WHERE decision <> 'unchanged'""",
    "migrate_corpus": """WITH a AS (SELECT DISTINCT lower(trim(id)) AS key FROM legal_source_archives),
k AS (SELECT id AS document_id, max(lower(trim(archive_id))) AS key, arg_max(CASE WHEN contains(lower(title), 'тогтоол') THEN 'GOVERNMENT_RESOLUTION' WHEN contains(lower(title), 'тушаал') THEN 'MINISTERIAL_ORDER' ELSE 'LAW' END, coalesce(lower(trim(archive_id)), '')) AS document_type FROM legal_knowledge_documents GROUP BY 1),
r AS (SELECT DISTINCT id, document_id, ord, 'article-' || coalesce(article_number, CAST(ord AS VARCHAR)) AS base FROM legal_knowledge_articles),
w AS (SELECT *, row_number() OVER (PARTITION BY document_id, base ORDER BY ord, id) AS i FROM r),
n AS (SELECT document_id, count(*) AS n, min(CASE WHEN i = 1 THEN base ELSE base || '__legacyId-' || id END) AS first_locator FROM w GROUP BY 1)
SELECT k.document_id, CASE WHEN a.key IS NOT NULL THEN 'migrated' ELSE 'no_matching_archive' END AS outcome, document_type, CASE WHEN a.key IS NOT NULL THEN coalesce(n, 0) + 1 ELSE 0 END AS n_nodes, CASE WHEN a.key IS NOT NULL THEN first_locator END AS first_locator
FROM k LEFT JOIN a USING (key) LEFT JOIN n USING (document_id)""",
    "locator_changes": f"""WITH {_N}, v AS (SELECT DISTINCT document_id, version_number, id FROM legal_document_versions WHERE status IN ('PUBLISHED', 'SUPERSEDED')),
p AS (SELECT * FROM (SELECT id, lag(id) OVER (PARTITION BY document_id ORDER BY version_number, id) AS replaces_id FROM v) WHERE replaces_id IS NOT NULL),
l AS (SELECT DISTINCT document_version_id, source_locator FROM n),
x AS (SELECT id, replaces_id, source_locator, 1 AS a, 0 AS b FROM p JOIN l ON l.document_version_id = id UNION ALL SELECT id, replaces_id, source_locator, 0, 1 FROM p JOIN l ON l.document_version_id = replaces_id),
y AS (SELECT id, replaces_id, source_locator, max(a) AS a, max(b) AS b FROM x GROUP BY 1, 2, 3)
SELECT id, replaces_id, count(*) FILTER (a = 0) AS n_missing, count(*) FILTER (b = 0) AS n_unexpected FROM y GROUP BY 1, 2""",
    "tree_preorder": """WITH RECURSIVE e AS (SELECT id, arg_max(parent_id, (updated_at, parent_id)) AS parent_id, strftime(min(created_at), '%Y%m%d%H%M%S%f') || '-' || id AS k FROM legal_nodes GROUP BY id),
t AS (SELECT e.id, CAST(0 AS BIGINT) AS depth, e.k AS place FROM e LEFT JOIN e p ON e.parent_id = p.id WHERE p.id IS NULL UNION ALL SELECT e.id, t.depth + 1, t.place || '/' || e.k FROM e JOIN t ON e.parent_id = t.id)
SELECT id AS node_id, depth, place FROM t""",
    "cascade_closure": f"""WITH RECURSIVE {_PAIRS}, d AS (SELECT DISTINCT id FROM legal_nodes WHERE document_version_id IN (SELECT id FROM legal_document_versions WHERE status = 'WITHDRAWN'))
SELECT DISTINCT t.id AS node_id FROM t, unnest(list_append(up, t.id)) AS u(a) WHERE a IN (SELECT id FROM d) UNION SELECT id FROM d""",
    "subtree_sizes": f"WITH RECURSIVE {_PAIRS} SELECT up[i] AS ancestor_id, count(*) AS n_below, max(i) AS height FROM t, unnest(range(1, len(up) + 1)) AS u(i) GROUP BY 1",
    "node_violations": f"""WITH x AS (SELECT id, coalesce(regexp_replace(source_locator, '{_BLANK}', '', 'g'), '') = '' AS l, coalesce(regexp_replace(content_hash, '{_BLANK}', '', 'g'), '') = '' AS h, document_version_id AS v FROM legal_nodes WHERE id IS NOT NULL),
y AS (SELECT id, concat_ws(',', CASE WHEN bool_or(l) THEN 'blank_locator' END, CASE WHEN bool_or(h) THEN 'blank_hash' END, CASE WHEN count(DISTINCT v) > 1 THEN 'several_versions' END, CASE WHEN count(*) > 1 THEN 'delivered_twice' END) AS violations FROM x GROUP BY 1) SELECT * FROM y WHERE violations <> ''""",
    "latest_editions": "WITH k AS (SELECT DISTINCT id, trim(law_id) AS law_id, version_no FROM legal_knowledge_documents WHERE trim(law_id) NOT IN ('', '0')) SELECT law_id, arg_max(id, (version_no, id)) AS id, max(version_no) AS version_no, count(*) AS n_editions FROM k GROUP BY 1",
}
