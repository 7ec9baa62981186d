"""Queries over versions, structure and references of the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.functions.urls import law_id
from lexcorpus.operators import audit, versions
from lexcorpus.tables import table

AT = "2015-06-01"
EXPECTED = ["doc", "art-1", "art-2/p-1", "art-7/p-2/c-1"]
PROBES = ["art-99999", "art-0", "art-1/p-99999"]
TABLES = ["legal_nodes", "legal_document_versions", "legal_documents", "citation_entries", "legal_knowledge_documents", "legal_knowledge_articles", "legal_source_archives", "legal_sources", "documents"]


def _v(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "legal_document_versions")


def asof_version(s: SparkSession, d: str) -> DataFrame:
    return versions.as_of(_v(s, d), AT).select("document_id", "id", "version_number", "status")


def current_version(s: SparkSession, d: str) -> DataFrame:
    return versions.current(_v(s, d)).select("document_id", "id", "version_number")


def published_overlap(s: SparkSession, d: str) -> DataFrame:
    return versions.overlaps(_v(s, d))


def published_overlap_half_open(s: SparkSession, d: str) -> DataFrame:
    return versions.overlaps(_v(s, d), closed=False)


def supersede_chain(s: SparkSession, d: str) -> DataFrame:
    return versions.succession(_v(s, d))


def next_version(s: SparkSession, d: str) -> DataFrame:
    return versions.next_numbers(table(s, d, "legal_documents"), _v(s, d))


def version_violations(s: SparkSession, d: str) -> DataFrame:
    return versions.violations(_v(s, d)).select("id", F.concat_ws(",", "violations").alias("violations"))


def version_provenance(s: SparkSession, d: str) -> DataFrame:
    return versions.provenance(_v(s, d))


def locator_assign(s: SparkSession, d: str) -> DataFrame:
    return audit.assign_locators(table(s, d, "legal_knowledge_articles"))


def locator_collisions(s: SparkSession, d: str) -> DataFrame:
    return audit.locator_collisions(table(s, d, "legal_knowledge_articles"))


def collision_detail(s: SparkSession, d: str) -> DataFrame:
    titles = table(s, d, "legal_knowledge_documents").groupBy(F.col("id").alias("document_id")).agg(F.min("title").alias("document_title"))
    return locator_collisions(s, d).join(titles, "document_id", "left").select("document_id", "document_title", "article_number", "n_rows", "winner_id")


def duplicate_locators(s: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_keys(audit.nodes_once(table(s, d, "legal_nodes"), audit.PLACE), ["document_version_id", "source_locator"])


def orphan_versions(s: SparkSession, d: str) -> DataFrame:
    return _v(s, d).join(table(s, d, "legal_documents").select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti").select("id", "document_id").distinct()


def data_quality(s: SparkSession, d: str) -> DataFrame:
    return audit.data_quality(table(s, d, "legal_nodes"), _v(s, d), table(s, d, "legal_documents"))


def version_structure(s: SparkSession, d: str) -> DataFrame:
    return audit.version_structure(table(s, d, "legal_nodes"))


def corpus_totals(s: SparkSession, d: str) -> DataFrame:
    """One row: sums over the structure of all versions, citations that lead back and don't, and what dates of published versions allow."""
    v = version_structure(s, d)
    sums = v.agg(F.count(F.lit(1)).alias("versions"), *[F.sum(c).alias(c) for c in ("nodes", "orphans", "invalid_parents", "incompatible_types", "duplicate_locators")], F.count_if(F.col("result") == "PASS").alias("passed"))
    failing = citation_roundtrip(s, d).agg(F.countDistinct("citation_id").alias("roundtrip_failing"))
    citations = table(s, d, "citation_entries").agg(F.countDistinct("id").alias("citations"))
    dated = F.col("effective_from").isNotNull() & F.col("effective_to").isNotNull()
    published = F.col("status") == "PUBLISHED"
    dates = _v(s, d).distinct().agg(F.count_if(published).alias("published"), F.count_if(published & ~dated).alias("as_of_gaps"), F.count_if(F.col("status") == "SUPERSEDED").alias("superseded"))
    # four rows of totals as one
    four = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [sums, failing, citations, dates])
    one = four.agg(*[F.max(c).alias(c) for c in four.columns])
    available = lambda c: F.when(c, "available").otherwise("unavailable")
    return one.withColumns({
        "roundtrip_ok": F.col("citations") - F.col("roundtrip_failing"),
        "current": available(F.col("published") > 0),
        "historical": available((F.col("published") > 0) & (F.col("as_of_gaps") == 0)),
        "gaps": F.concat_ws(",", F.when(F.col("as_of_gaps") > 0, "as_of_gap"), F.when(F.col("superseded") == 0, "version_history_gap")),
    })


def orphan_citations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "citation_entries").join(_v(s, d).select(F.col("id").alias("document_version_id")).distinct(), "document_version_id", "left_anti").select("id", "document_version_id").distinct()


def repeated_articles(s: SparkSession, d: str) -> DataFrame:
    return audit.repeats(table(s, d, "legal_knowledge_articles").where("article_number is not null"), ["document_id", "article_number"], ["ord", "id"])


def parent_violations(s: SparkSession, d: str) -> DataFrame:
    return audit.parent_report(table(s, d, "legal_nodes")).where("orphan or foreign_parent or invalid_parent or incompatible")


def parse_shape(s: SparkSession, d: str) -> DataFrame:
    return audit.parse_shape(table(s, d, "legal_nodes"))


def citation_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return audit.citation_round_trip(table(s, d, "citation_entries"), table(s, d, "legal_nodes"))


def roundtrip_totals(s: SparkSession, d: str) -> DataFrame:
    bad = citation_roundtrip(s, d).groupBy("reason").agg(F.countDistinct("citation_id").alias("n"))
    return bad


def locator_grammar(s: SparkSession, d: str) -> DataFrame:
    return audit.nodes_once(table(s, d, "legal_nodes"), audit.PLACE).select("node_type", F.coalesce(F.rlike("source_locator", F.lit(audit.LOCATOR)), F.lit(False)).alias("well_formed")).groupBy("node_type", "well_formed").agg(F.count(F.lit(1)).alias("n"))


def negative_probes(s: SparkSession, d: str) -> DataFrame:
    return audit.unknown_locators(table(s, d, "legal_documents"), _v(s, d), table(s, d, "legal_nodes"), PROBES)


def expected_locators(s: SparkSession, d: str) -> DataFrame:
    law = law_id(F.col("canonical_url"))
    e = table(s, d, "legal_documents").select(law.alias("law_id"), F.explode(F.array(*map(F.lit, EXPECTED))).alias("locator")).where("law_id is not null")
    return audit.expected_locators(table(s, d, "legal_documents"), _v(s, d), table(s, d, "legal_nodes"), e)


def offenders(s: SparkSession, d: str) -> DataFrame:
    return audit.offenders(table(s, d, "legal_nodes"))


def table_counts(s: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(s, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES])


QUERIES = {
    f.__name__: f
    for f in (
        asof_version, current_version, published_overlap, published_overlap_half_open, supersede_chain, next_version, version_violations, version_provenance, locator_assign, locator_collisions, collision_detail, duplicate_locators, orphan_versions,
        data_quality, orphan_citations, repeated_articles, version_structure, corpus_totals, parent_violations, parse_shape, citation_roundtrip, roundtrip_totals, locator_grammar, negative_probes, expected_locators, offenders, table_counts,
    )
}

_N = "n AS (SELECT id, unnest(arg_max(struct_pack(document_version_id, parent_id, node_type, chapter, article, paragraph, title, text, source_locator, content_hash), updated_at)) FROM legal_nodes WHERE id IS NOT NULL GROUP BY id)"
_BLANK = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_PAIRS = ", ".join(f"('{c}', '{p}')" for c, ps in audit.ALLOWED_PARENTS.items() for p in ps)
_REPORT = f"""{_N},
a(child, parent) AS (VALUES {_PAIRS}),
j AS (
  SELECT n.*, p.id AS pid, p.node_type AS p_type, coalesce(p.document_version_id = n.document_version_id, false) AS same
  FROM n LEFT JOIN n p ON p.id = n.parent_id
),
r AS (
  SELECT id, document_version_id, source_locator, node_type, parent_id IS NOT NULL AND NOT same AS orphan, pid IS NOT NULL AND NOT same AS foreign_parent,
    (parent_id IS NOT NULL AND NOT same) OR (parent_id IS NULL AND coalesce(node_type, '') <> 'DOCUMENT') AS invalid_parent,
    same AND NOT EXISTS (SELECT 1 FROM a WHERE a.child = j.node_type AND a.parent = j.p_type) AS incompatible
  FROM j
)"""
_STRUCTURE = f"""{_REPORT},
x AS (SELECT document_version_id, count(*) - count(DISTINCT source_locator) AS duplicate_locators, count(*) FILTER (node_type = 'DOCUMENT' AND parent_id IS NULL) AS document_parents FROM n GROUP BY 1),
y AS (SELECT document_version_id, count(*) AS nodes, count(*) FILTER (orphan) AS orphans, count(*) FILTER (invalid_parent) AS invalid_parents, count(*) FILTER (incompatible) AS incompatible_types FROM r GROUP BY 1),
z AS (SELECT *, CASE WHEN document_parents = 1 AND orphans + invalid_parents + incompatible_types + duplicate_locators = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM y JOIN x USING (document_version_id))"""
_OVERLAP = """WITH v AS (SELECT DISTINCT document_id, id, coalesce(effective_from, TIMESTAMP '0001-01-01') AS s, coalesce(effective_to, TIMESTAMP '9999-12-31') AS e FROM legal_document_versions WHERE status = 'PUBLISHED'),
w AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v {extra})
SELECT document_id, id, reached FROM w WHERE s {op} reached"""
_COLLIDE = """c AS (
  SELECT document_id, article_number, count(*) AS n_rows, count(*) - 1 AS excess, count(DISTINCT coalesce(text, '')) = 1 AS same_text, count(DISTINCT coalesce(title, '')) = 1 AS same_title, arg_min(id, (ord, id)) AS winner_id
  FROM (SELECT DISTINCT id, document_id, article_number, ord, text, title FROM legal_knowledge_articles WHERE article_number IS NOT NULL) GROUP BY 1, 2 HAVING count(*) > 1
)"""
_TRIP = f"""{_N},
c AS (SELECT DISTINCT id, legal_node_id, document_version_id, locator, exact_text, content_hash FROM citation_entries),
j AS (SELECT c.id AS citation_id, c.locator, c.document_version_id AS cv, c.exact_text, c.content_hash AS ch, n.id AS nid, n.source_locator, n.document_version_id AS nv, n.node_type, n.text, n.content_hash AS nh FROM c LEFT JOIN n ON n.id = c.legal_node_id),
f AS (
  SELECT citation_id, 'missing_node' AS reason FROM j WHERE nid IS NULL
  UNION ALL SELECT citation_id, 'locator_mismatch' FROM j WHERE nid IS NOT NULL AND source_locator IS DISTINCT FROM locator
  UNION ALL SELECT citation_id, 'version_mismatch' FROM j WHERE nid IS NOT NULL AND nv IS DISTINCT FROM cv
  UNION ALL SELECT citation_id, 'empty_source_text' FROM j WHERE nid IS NOT NULL AND node_type IN ('ARTICLE', 'PARAGRAPH', 'CLAUSE', 'SUB_CLAUSE') AND coalesce(regexp_replace(text, '{_BLANK}', '', 'g'), '') = ''
  UNION ALL SELECT citation_id, 'empty_citation_text' FROM j WHERE nid IS NOT NULL AND coalesce(regexp_replace(exact_text, '{_BLANK}', '', 'g'), '') = ''
  UNION ALL SELECT citation_id, 'missing_content_hash' FROM j WHERE nid IS NOT NULL AND (coalesce(trim(ch), '') = '' OR coalesce(trim(nh), '') = '')
)"""

ORACLE = {
    "asof_version": f"""SELECT document_id, arg_max(id, (version_number, id)) AS id, max(version_number) AS version_number, arg_max(status, (version_number, id)) AS status FROM legal_document_versions
WHERE status IN ('PUBLISHED', 'SUPERSEDED') AND effective_from <= TIMESTAMP '{AT}' AND TIMESTAMP '{AT}' < effective_to GROUP BY 1""",
    "current_version": "SELECT document_id, arg_max(id, (version_number, id)) AS id, max(version_number) AS version_number FROM legal_document_versions WHERE status = 'PUBLISHED' GROUP BY 1",
    "published_overlap": _OVERLAP.format(extra="", op="<="),
    "published_overlap_half_open": _OVERLAP.format(extra="WHERE s < e", op="<"),
    "supersede_chain": """WITH v AS (SELECT DISTINCT document_id, version_number, id, effective_from, effective_to FROM legal_document_versions WHERE status IN ('PUBLISHED', 'SUPERSEDED'))
SELECT document_id, version_number, id, lag(id) OVER w AS replaces_id, lead(id) OVER w AS replaced_by_id, coalesce(effective_to, lead(effective_from) OVER w) AS in_force_until FROM v WINDOW w AS (PARTITION BY document_id ORDER BY version_number, id)""",
    "next_version": "SELECT d.id AS document_id, coalesce(max(version_number), 0) + 1 AS next_version FROM (SELECT DISTINCT id FROM legal_documents) d LEFT JOIN legal_document_versions v ON v.document_id = d.id GROUP BY 1",
    "version_violations": """SELECT DISTINCT id, concat_ws(',', CASE WHEN coalesce(version_number < 1, true) THEN 'version_number' END, CASE WHEN coalesce(trim(content_hash), '') = '' THEN 'content_hash' END, CASE WHEN coalesce(trim(parser_id), '') = '' THEN 'parser_id' END,
  CASE WHEN coalesce(trim(archive_record_id), '') = '' THEN 'archive_record_id' END, CASE WHEN effective_from > effective_to THEN 'reversed_bounds' END) AS violations
FROM legal_document_versions WHERE violations <> ''""",
    "version_provenance": """SELECT document_id, count(*) AS n_versions, count(*) FILTER (effective_from IS NOT NULL AND effective_to IS NOT NULL) AS n_closed, bool_and(effective_from IS NOT NULL AND effective_to IS NOT NULL) AS historical
FROM (SELECT DISTINCT document_id, id, effective_from, effective_to FROM legal_document_versions) GROUP BY 1""",
    "locator_assign": """WITH r AS (SELECT DISTINCT id, document_id, ord, 'article-' || coalesce(article_number, CAST(ord AS VARCHAR)) AS base FROM legal_knowledge_articles),
w AS (SELECT *, row_number() OVER (PARTITION BY document_id, base ORDER BY ord, id) AS k, count(*) OVER (PARTITION BY document_id, base) AS n FROM r)
SELECT id, document_id, CASE WHEN k = 1 THEN base ELSE base || '__legacyId-' || id END AS source_locator, n > 1 AS collides FROM w""",
    "locator_collisions": f"WITH {_COLLIDE} SELECT * FROM c",
    "collision_detail": f"WITH {_COLLIDE} SELECT document_id, t.title AS document_title, article_number, n_rows, winner_id FROM c LEFT JOIN (SELECT id, min(title) AS title FROM legal_knowledge_documents GROUP BY 1) t ON t.id = c.document_id",
    "duplicate_locators": f"WITH {_N} SELECT document_version_id, source_locator, count(*) AS n FROM n GROUP BY 1, 2 HAVING count(*) > 1",
    "orphan_versions": "SELECT DISTINCT id, document_id FROM legal_document_versions v WHERE NOT EXISTS (SELECT 1 FROM legal_documents d WHERE d.id = v.document_id)",
    "data_quality": f"""WITH {_N}, v AS (SELECT DISTINCT id, document_id, version_number FROM legal_document_versions)
SELECT 'duplicate_locators' AS problem, (SELECT count(*) FROM (SELECT 1 FROM n GROUP BY document_version_id, source_locator HAVING count(*) > 1)) AS n
UNION ALL SELECT 'malformed_locators', (SELECT count(*) FROM n WHERE NOT coalesce(regexp_matches(source_locator, '{audit.LOCATOR}'), false))
UNION ALL SELECT 'empty_texts', (SELECT count(*) FROM n WHERE coalesce(regexp_replace(text, '{_BLANK}', '', 'g'), '') = '')
UNION ALL SELECT 'versions_without_document', (SELECT count(*) FROM v WHERE document_id NOT IN (SELECT id FROM legal_documents))
UNION ALL SELECT 'duplicate_version_numbers', (SELECT count(*) FROM (SELECT 1 FROM v GROUP BY document_id, version_number HAVING count(*) > 1))
UNION ALL SELECT 'nodes_delivered_twice', (SELECT count(*) FROM (SELECT 1 FROM legal_nodes GROUP BY id HAVING count(*) > 1))""",
    "version_structure": f"WITH {_STRUCTURE} SELECT * FROM z",
    "corpus_totals": f"""WITH {_STRUCTURE}, q AS (WITH {_TRIP} SELECT count(DISTINCT citation_id) AS failing FROM f), c AS (SELECT count(DISTINCT id) AS citations FROM citation_entries),
w AS (SELECT count(*) FILTER (status = 'PUBLISHED') AS published, count(*) FILTER (status = 'PUBLISHED' AND (effective_from IS NULL OR effective_to IS NULL)) AS as_of_gaps, count(*) FILTER (status = 'SUPERSEDED') AS superseded FROM (SELECT DISTINCT * FROM legal_document_versions)),
s AS (SELECT count(*) AS versions, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(orphans) AS BIGINT) AS orphans, CAST(sum(invalid_parents) AS BIGINT) AS invalid_parents, CAST(sum(incompatible_types) AS BIGINT) AS incompatible_types, CAST(sum(duplicate_locators) AS BIGINT) AS duplicate_locators, count(*) FILTER (result = 'PASS') AS passed FROM z)
SELECT s.*, failing AS roundtrip_failing, citations, published, as_of_gaps, superseded, citations - failing AS roundtrip_ok, CASE WHEN published > 0 THEN 'available' ELSE 'unavailable' END AS current, CASE WHEN published > 0 AND as_of_gaps = 0 THEN 'available' ELSE 'unavailable' END AS historical,
  concat_ws(',', CASE WHEN as_of_gaps > 0 THEN 'as_of_gap' END, CASE WHEN superseded = 0 THEN 'version_history_gap' END) AS gaps FROM s, q, c, w""",
    "orphan_citations": "SELECT DISTINCT id, document_version_id FROM citation_entries c WHERE NOT EXISTS (SELECT 1 FROM legal_document_versions v WHERE v.id = c.document_version_id)",
    "repeated_articles": """WITH r AS (SELECT DISTINCT id, document_id, article_number, ord FROM legal_knowledge_articles WHERE article_number IS NOT NULL), f AS (SELECT document_id, article_number, arg_min(id, (ord, id)) AS first_id FROM r GROUP BY 1, 2)
SELECT DISTINCT document_id, article_number, id, first_id FROM r JOIN f USING (document_id, article_number) WHERE id <> first_id""",
    "parent_violations": f"WITH {_REPORT} SELECT * FROM r WHERE orphan OR foreign_parent OR invalid_parent OR incompatible",
    "parse_shape": f"WITH {_N} SELECT document_version_id, count(*) AS n_nodes, " + ", ".join(f"count(*) FILTER (node_type = '{t}') AS n_{t.lower()}" for t in ("BOOK", "CHAPTER", "ARTICLE", "PARAGRAPH", "CLAUSE", "SUB_CLAUSE", "ANNEX")) + ", count(*) FILTER (node_type = 'ARTICLE' AND contains(article, '^')) AS n_inserted, count(*) - count(DISTINCT source_locator) AS n_surplus_locators FROM n GROUP BY 1",
    "citation_roundtrip": f"WITH {_TRIP} SELECT * FROM f",
    "roundtrip_totals": f"WITH {_TRIP} SELECT reason, count(DISTINCT citation_id) AS n FROM f GROUP BY 1",
    "locator_grammar": f"WITH {_N} SELECT node_type, coalesce(regexp_matches(source_locator, '{audit.LOCATOR}'), false) AS well_formed, count(*) AS n FROM n GROUP BY 1, 2",
    "negative_probes": f"""WITH p(locator) AS (VALUES {', '.join(f"('{x}')" for x in PROBES)}), d AS (SELECT DISTINCT id AS document_id FROM legal_documents),
h AS (SELECT document_id, source_locator AS locator, count(*) AS n FROM (SELECT DISTINCT document_version_id, source_locator FROM legal_nodes) n JOIN (SELECT DISTINCT id, document_id FROM legal_document_versions) v ON v.id = n.document_version_id GROUP BY 1, 2)
SELECT document_id, locator, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'VALID' ELSE 'CONFLICT' END AS status FROM d CROSS JOIN p LEFT JOIN h USING (document_id, locator)""",
    "expected_locators": f"""WITH {_N}, d AS (SELECT id AS document_id, arg_max(canonical_url, (updated_at, canonical_url)) AS u FROM legal_documents GROUP BY id),
a AS (SELECT DISTINCT coalesce(nullif(regexp_extract(canonical_url, '(?i)[?&]lawid=([^&#]+)', 1), ''), nullif(regexp_extract(canonical_url, '/details?/([0-9]+)', 1), '')) AS law_id FROM legal_documents),
e AS (SELECT law_id, unnest([{", ".join(repr(x) for x in EXPECTED)}]) AS locator FROM a WHERE law_id IS NOT NULL),
b AS (SELECT document_id, coalesce(nullif(regexp_extract(u, '(?i)[?&]lawid=([^&#]+)', 1), ''), nullif(regexp_extract(u, '/details?/([0-9]+)', 1), '')) AS law_id FROM d),
v AS (SELECT DISTINCT id, document_id FROM legal_document_versions WHERE status = 'PUBLISHED'),
k AS (SELECT law_id, source_locator AS locator, v.id, count(*) AS n FROM b JOIN v USING (document_id) JOIN n ON n.document_version_id = v.id GROUP BY 1, 2, 3),
h AS (SELECT law_id, locator, max(n) AS n FROM k GROUP BY 1, 2)
SELECT law_id, locator, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'VALID' ELSE 'AMBIGUOUS' END AS status FROM e LEFT JOIN h USING (law_id, locator)""",
    "offenders": f"""WITH {_N}, f AS (SELECT id, 'empty_text' AS problem FROM n WHERE coalesce(regexp_replace(text, '{_BLANK}', '', 'g'), '') = '' UNION ALL SELECT id, 'no_title' FROM n WHERE title IS NULL UNION ALL SELECT id, 'malformed_locator' FROM n WHERE NOT coalesce(regexp_matches(source_locator, '{audit.LOCATOR}'), false))
SELECT problem, count(*) AS n, array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') AS sample FROM f GROUP BY 1""",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
}
