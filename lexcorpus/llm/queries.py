"""Queries of the problems tagged llm, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.llm.lookalikes import consistent, disguised, expression
from lexcorpus.llm.matching import matches
from lexcorpus.llm.mixing import mix, shares
from lexcorpus.llm.neardup import NearDuplicates, Similar, groups, pairs_across_documents, provisions
from lexcorpus.llm.packing import fill, pack
from lexcorpus.llm.sentences import sentences
from lexcorpus.tables import records, table


def _near(spark: SparkSession, d: str, similar: Similar) -> NearDuplicates:
    t = [table(spark, d, x) for x in ("legal_nodes", "legal_document_versions", "legal_knowledge_articles")]
    return NearDuplicates(provisions(*t, similar.min_words), similar)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_across_documents(_near(spark, d, Similar(words=3, threshold=0.5, bands=44)))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(_near(spark, d, Similar()))


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("adopted_at", "yyyy-MM-dd").alias("day")
    acts = table(spark, d, "legal_documents").select("id", "title", F.col("document_number").alias("number"), day, F.col("canonical_url").alias("address"), "jurisdiction", F.col("document_type").alias("kind"))
    known = table(spark, d, "legal_knowledge_documents").select("id", "title", F.col("law_id").alias("number"), F.col("valid_from").alias("day"), F.col("source_url").alias("address"), "jurisdiction", F.col("document_type").alias("kind"))
    return matches(acts, known)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("document_id", "knowledge_id").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return disguised(table(spark, d, "legal_nodes"), table(spark, d, "legal_document_versions"), ["title", "text"])


def p6_consistent(spark: SparkSession, d: str) -> DataFrame:
    nodes = records(table(spark, d, "legal_nodes"), "id", ["title", "text"], ["updated_at"])
    return consistent(nodes, ["title", "text"], ["id"])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(p7_containers(spark, d), table(spark, d, "pack_capacities"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"))


def p9_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), with_text=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_matches, p3_found, p6_found, p6_consistent, p7_containers, p7_fill, p8_mix, p8_shares, p9_found, p9_units)}
_LATEST = "n AS (SELECT id, unnest(arg_max(struct_pack(document_version_id, source_locator, title, text), (updated_at, document_version_id, source_locator, title, text))) FROM legal_nodes WHERE id IS NOT NULL GROUP BY id)"
_OWNER = "v AS (SELECT DISTINCT id AS document_version_id, document_id FROM legal_document_versions)"

#: The rest can't be said in SQL, or only by what it is to check.
ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {_OWNER}, r AS (SELECT id, 'd:' || document_id AS doc, text FROM (SELECT DISTINCT id, document_version_id, text FROM legal_nodes) JOIN v USING (document_version_id) UNION ALL SELECT DISTINCT id, 'k:' || document_id, text FROM legal_knowledge_articles),
w AS (SELECT id, doc, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM r WHERE text IS NOT NULL),
g AS (SELECT id, doc, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 20),
c AS (SELECT min(id) AS rep, g FROM g GROUP BY g),
m AS (SELECT g.id, g.doc, c.rep FROM g JOIN c ON g.g = c.g),
s AS (SELECT rep, len(g) AS n, unnest(g) AS s FROM c),
k AS (SELECT a.rep AS x, b.rep AS y, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn FROM s a JOIN s b ON a.s = b.s AND a.rep <= b.rep GROUP BY 1, 2),
l AS (SELECT x, y FROM k WHERE 2 * k >= an + bn - k)
SELECT DISTINCT least(a.id, b.id) AS a_id, greatest(a.id, b.id) AS b_id FROM l JOIN m a ON a.rep = x JOIN m b ON b.rep = y WHERE a.doc <> b.doc""",
    "p6_found": f"""WITH {_LATEST}, {_OWNER}, f AS (
  SELECT id, document_version_id, source_locator, 'title' AS field_name, title AS raw, {expression('title')} AS form FROM n WHERE title <> '' UNION ALL SELECT id, document_version_id, source_locator, 'text', text, {expression('text')} FROM n WHERE text <> ''),
d AS (SELECT f.*, document_id FROM f JOIN v USING (document_version_id))
SELECT DISTINCT a.id AS a_id, b.id AS b_id, a.field_name FROM d a JOIN d b USING (document_id, source_locator, field_name, form) WHERE a.id < b.id AND a.document_version_id <> b.document_version_id AND a.raw <> b.raw""",
    "p6_consistent": f"WITH c AS (SELECT id, unnest(arg_max(struct_pack(title, text), (updated_at, title, text))) FROM legal_nodes GROUP BY id) SELECT id, {expression('title')} AS title, {expression('text')} AS text FROM c",
}
