"""Queries of retrieval, verification, search and citation functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.functions import citations as C
from lexcorpus.operators import retrieval as R
from lexcorpus.operators import search as S
from lexcorpus.operators.audit import nodes_once
from lexcorpus.plans.corpus import _BLANK, _N
from lexcorpus.staging import Stage
from lexcorpus.tables import records, table

QUESTION = "хариуцлага хүлээлгэх журам"
TERMS = "хууль хяналт гэрээ"
WEB = '"нийт хууль" or хариуцлага -татвар'


def _t(s: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(s, d, n) for n in names]


def retrieve_authorities(s: SparkSession, d: str) -> DataFrame:
    return R.authorities(*_t(s, d, "legal_nodes", "legal_document_versions", "legal_documents"))


def citation_index(s: SparkSession, d: str) -> DataFrame:
    return R.citation_index(*_t(s, d, "legal_nodes", "legal_document_versions", "legal_documents"))


def citation_backfill(s: SparkSession, d: str) -> DataFrame:
    return R.backfill_needs(*_t(s, d, "legal_nodes", "citation_entries"))


def missing_citations(s: SparkSession, d: str) -> DataFrame:
    return R.missing_citations(*_t(s, d, "legal_nodes", "citation_entries"))


def _public(s: SparkSession, d: str, instant: str | None = None) -> DataFrame:
    return R.public_citations(*_t(s, d, "citation_entries", "legal_nodes", "legal_document_versions"), instant)


def _none() -> Column:
    return F.lit(None).cast("string")


def _verified(s: SparkSession, d: str, asked: DataFrame, instant: str | None = None) -> DataFrame:
    out = R.verify(asked, _public(s, d, instant), table(s, d, "legal_documents"))
    return out.withColumn("reasons", F.concat_ws(",", R.reasons(F.col("verdict"), instant is not None)))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "citation_entries").select(F.col("id").alias("candidate_id"), F.col("citation_key").alias("query")).distinct().select("candidate_id", "query", _none().alias("node_id"), _none().alias("locator"))


def verify_batch(s: SparkSession, d: str) -> DataFrame:
    return _verified(s, d, _asked(s, d))


def verify_batch_asof(s: SparkSession, d: str) -> DataFrame:
    return _verified(s, d, _asked(s, d), "2015-06-01")


def _phrases(s: SparkSession, d: str) -> DataFrame:
    """Every article as a phrase names it: (candidate_id, query, document_id, article, source_locator)."""
    n = nodes_once(table(s, d, "legal_nodes"), ["document_version_id", "article", "source_locator"]).where("article is not null")
    v = table(s, d, "legal_document_versions").select(F.col("id").alias("document_version_id"), "document_id").distinct()
    t = records(table(s, d, "legal_documents"), "id", ["title"], ["updated_at"]).select(F.col("id").alias("document_id"), "title")
    said = F.concat(F.coalesce("title", F.lit("")), F.lit(" хуулийн "), "article", F.lit(" дүгээр  зүйл"))
    return n.join(v, "document_version_id").join(t, "document_id").select(F.col("id").alias("candidate_id"), said.alias("query"), "document_id", "article", "source_locator")


def verify_phrases(s: SparkSession, d: str) -> DataFrame:
    return _verified(s, d, _phrases(s, d).select("candidate_id", "query", _none().alias("node_id"), _none().alias("locator")))


def verify_candidates(s: SparkSession, d: str) -> DataFrame:
    p = _phrases(s, d)
    short = F.concat("article", F.lit(" дүгээр зүйл"))
    kinds = [
        ("d", short, _none(), F.col("document_id"), _none()), ("l", F.col("query"), _none(), _none(), F.concat("source_locator", F.lit("/p-1"))), ("n", F.lit("?"), F.col("candidate_id"), _none(), _none()), ("x", F.col("query"), F.col("candidate_id"), F.lit("no document"), _none()),
        ("p", F.concat("article", F.lit(".1")), _none(), F.col("document_id"), _none()),
    ]
    each = F.array(*[F.struct(F.concat(F.lit(k), "candidate_id").alias("candidate_id"), q.alias("query"), n.alias("node_id"), o.alias("document_id"), at.alias("locator")) for k, q, n, o, at in kinds])
    return _verified(s, d, p.select(F.inline(each)))


def retrieve_citations_batch(s: SparkSession, d: str) -> DataFrame:
    return R.retrieve_batch(_asked(s, d), _public(s, d), table(s, d, "legal_documents")).select("candidate_id", "document_version_id", "legal_node_id", "title", "excerpt")


def relation_edges(s: SparkSession, d: str) -> DataFrame:
    return R.amendments(table(s, d, "legal_document_versions"))


def relation_scope(s: SparkSession, d: str) -> DataFrame:
    repealed = table(s, d, "legal_documents").where("status = 'REPEALED'").select(F.col("id").alias("document_id"))
    return R.touching(relation_edges(s, d), repealed)


def fts_candidates(s: SparkSession, d: str) -> DataFrame:
    n = nodes_once(table(s, d, "legal_nodes"))
    return n.where(S.websearch(S.lexemes(F.concat_ws(" ", "title", "text")), TERMS)).select("id", "document_version_id", "source_locator")


def fts_websearch(s: SparkSession, d: str) -> DataFrame:
    n = nodes_once(table(s, d, "legal_nodes"))
    return n.where(S.websearch(S.lexemes(F.concat_ws(" ", "title", "text")), WEB)).select("id", "source_locator")


def trigram_titles(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "legal_documents").select("id", "title").distinct()
    return t.select("id", "title", F.round(S.similarity(F.col("title"), QUESTION), 6).alias("sim")).where("sim > 0")


def trigram_title_topk(s: SparkSession, d: str) -> DataFrame:
    n = nodes_once(table(s, d, "legal_nodes")).where("title is not null")
    return n.select("id", "title", F.round(S.similarity(F.col("title"), QUESTION), 6).alias("sim")).where(f"sim >= {S.TITLE_SIMILARITY}").orderBy(F.desc("sim"), "id").limit(20)


def token_overlap_score(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select("doc_id", S.token_overlap(docs, "text", QUESTION).alias("score")).where("score > 0")


def _index(s: SparkSession, d: str) -> S.Index:
    """The index of a folder's nodes, built once an application as long as its tables stay."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES or not _INDEXES[key][1].alive():
        stage = Stage(s, "index")
        _INDEXES[key] = (S.build_index(nodes_once(table(s, d, "legal_nodes"), ["document_version_id", "source_locator", "title", "text"]), stage.write), stage)
    return _INDEXES[key][0]


_INDEXES: dict[tuple[str, str], tuple[S.Index, Stage]] = {}


def open_question(s: SparkSession, d: str) -> DataFrame:
    return S.open_question_indexed(_index(s, d), table(s, d, "legal_document_versions"), QUESTION).withColumn("score", F.round("score", 9))


def open_question_asof(s: SparkSession, d: str) -> DataFrame:
    return S.open_question_indexed(_index(s, d), table(s, d, "legal_document_versions"), QUESTION, "2015-06-01").withColumn("score", F.round("score", 9))


def open_question_scan(s: SparkSession, d: str) -> DataFrame:
    return S.open_question(nodes_once(table(s, d, "legal_nodes"), ["document_version_id", "source_locator", "title", "text"]), table(s, d, "legal_document_versions"), TERMS).withColumn("score", F.round("score", 9))


def index_postings(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).postings.groupBy("term").agg(F.countDistinct("id").alias("n_nodes"), F.count(F.lit(1)).alias("n_places"), F.max("at").alias("last_place"))


def parse_citation(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "citation_entries").select("id", "exact_text").distinct()
    return c.select("id", C.parse_phrase(F.col("exact_text")).alias("p")).select("id", "p.*").where("article is not null")


def normalize_citation(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "citation_entries").select("id", "exact_text").distinct()
    return c.select("id", C.normalizer()(F.col("exact_text")).alias("p")).select("id", "p.*").drop("original_text")


def fold_citation(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "legal_documents").select("id", "title").distinct().select("id", C.folder()(F.col("title")).alias("folded"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieve_authorities, citation_index, citation_backfill, missing_citations, verify_batch, verify_batch_asof, verify_phrases, verify_candidates, retrieve_citations_batch, relation_edges, relation_scope, fts_candidates, fts_websearch, trigram_titles,
        trigram_title_topk, token_overlap_score, open_question, open_question_asof, open_question_scan, index_postings, parse_citation, normalize_citation, fold_citation,
    )
}

_LAW = "coalesce(nullif(regexp_extract(canonical_url, '(?i)[?&]lawid=([^&#]+)', 1), ''), nullif(regexp_extract(canonical_url, '/details?/([0-9]+)', 1), ''))"
_D = "d AS (SELECT id, unnest(arg_max(struct_pack(title, canonical_url, document_number), (updated_at, title))) FROM legal_documents GROUP BY id)"
_V = "v AS (SELECT DISTINCT id, document_id, content_hash FROM legal_document_versions)"
_INDEX = f"""SELECT n.document_version_id, n.id AS legal_node_id, coalesce(nullif(coalesce({_LAW}, document_number), '') || ':' || source_locator, source_locator) AS citation_key, source_locator AS locator, text AS exact_text, canonical_url AS source_url,
  coalesce(nullif(n.content_hash, ''), v.content_hash) AS content_hash, 'VALID' AS status FROM n JOIN v ON v.id = n.document_version_id JOIN d ON d.id = v.document_id WHERE node_type <> 'DOCUMENT'"""


def _pub(where: str) -> str:
    return f"""t AS (SELECT id, arg_max(title, (updated_at, title)) AS title FROM legal_documents GROUP BY id),
pub AS (SELECT DISTINCT c.citation_key, c.locator, c.legal_node_id, c.document_version_id, c.exact_text, n.title, n.node_type, n.article, n.paragraph, v.document_id, t.title AS act FROM citation_entries c
  JOIN (SELECT DISTINCT id, document_id FROM legal_document_versions WHERE {where}) v ON v.id = c.document_version_id JOIN n ON n.id = c.legal_node_id LEFT JOIN t ON t.id = v.document_id)"""


_NOW, _THEN = _pub("status = 'PUBLISHED'"), _pub("status IN ('PUBLISHED', 'SUPERSEDED') AND effective_from <= TIMESTAMP '2015-06-01' AND TIMESTAMP '2015-06-01' < effective_to")


def _spaced(q: str) -> str:
    return f"trim(regexp_replace({q}, '{_BLANK}+', ' ', 'g'))"


_PH = "(?i)([0-9]+)\\s*(?:\\.\\s*([0-9]+))?\\s*(?:дүгээр|дугаар|дэх)?\\s*зүйл"
_DOT = "\\b([0-9]+)\\.([0-9]+)\\b"


def _parsed(q: str) -> str:
    x = lambda k: f"coalesce(nullif(regexp_extract({q}, '{_PH}', {k}), ''), nullif(regexp_extract({q}, '{_DOT}', {k}), ''))"
    return f"{x(1)} AS article, {x(2)} AS paragraph, nullif(regexp_extract({q}, '(?i)^(.+?)\\s+хуулийн(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '') AS title_hint"


_LOC = "'art-' || article || coalesce('/p-' || paragraph, '')"


def _matches(asked: str) -> str:
    """m: the provisions each candidate (candidate_id, query, node_id, document_id, locator) names."""
    return f"""a AS ({asked}), q AS (SELECT *, {_spaced('query')} AS said FROM a), p AS (SELECT * EXCLUDE (locator), coalesce(locator, {_LOC}) AS locator FROM (SELECT *, {_parsed('said')} FROM q)),
u AS (
  SELECT candidate_id, p.document_id AS only_in, title_hint, pub.* FROM p JOIN pub ON pub.citation_key = p.query
  UNION ALL SELECT candidate_id, p.document_id, title_hint, pub.* FROM p JOIN pub ON pub.locator = p.query
  UNION ALL SELECT candidate_id, p.document_id, title_hint, pub.* FROM p JOIN pub ON pub.locator = p.locator
  UNION ALL SELECT candidate_id, p.document_id, title_hint, pub.* FROM p JOIN pub ON pub.legal_node_id = p.node_id
  UNION ALL SELECT candidate_id, p.document_id, title_hint, pub.* FROM p JOIN pub ON pub.article = p.article AND CASE WHEN p.paragraph IS NULL THEN pub.node_type = 'ARTICLE' ELSE pub.node_type = 'PARAGRAPH' AND pub.paragraph = p.paragraph END
),
m AS (SELECT DISTINCT candidate_id, document_version_id, legal_node_id FROM u WHERE (only_in IS NULL OR only_in = document_id) AND (title_hint IS NULL OR contains(lower(act), lower(title_hint))))"""


def _verdicts(asked: str, unavailable: str = "") -> str:
    return f"""{_matches(asked)},
g AS (SELECT a.candidate_id, count(document_version_id) AS k, min(document_version_id) AS dv, min(legal_node_id) AS nd FROM a LEFT JOIN m USING (candidate_id) GROUP BY 1),
w AS (SELECT candidate_id, CASE k WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'VALID' ELSE 'CONFLICT' END AS verdict, CASE WHEN k = 1 THEN dv END AS document_version_id, CASE WHEN k = 1 THEN nd END AS legal_node_id,
  CASE k WHEN 0 THEN 'citation_unresolved{unavailable}' WHEN 1 THEN 'citation_unique' ELSE 'citation_conflict' END AS reasons FROM g)"""


_ASK = "SELECT DISTINCT id AS candidate_id, citation_key AS query, NULL :: VARCHAR AS node_id, NULL :: VARCHAR AS document_id, NULL :: VARCHAR AS locator FROM citation_entries"
_ARTICLES = f"""SELECT n.id, coalesce(t.title, '') || ' хуулийн ' || article || ' дүгээр  зүйл' AS said, v.document_id, article, source_locator FROM n JOIN (SELECT DISTINCT id, document_id FROM legal_document_versions) v ON v.id = n.document_version_id JOIN t ON t.id = v.document_id WHERE article IS NOT NULL"""
_PHRASES = f"SELECT id AS candidate_id, said AS query, NULL :: VARCHAR AS node_id, NULL :: VARCHAR AS document_id, NULL :: VARCHAR AS locator FROM ({_ARTICLES})"
_CANDIDATES = f"""WITH r AS ({_ARTICLES}) SELECT 'd' || id AS candidate_id, article || ' дүгээр зүйл' AS query, NULL :: VARCHAR AS node_id, document_id, NULL :: VARCHAR AS locator FROM r
  UNION ALL SELECT 'l' || id, said, NULL, NULL, source_locator || '/p-1' FROM r UNION ALL SELECT 'n' || id, '?', id, NULL, NULL FROM r UNION ALL SELECT 'x' || id, said, id, 'no document', NULL FROM r UNION ALL SELECT 'p' || id, article || '.1', NULL, document_id, NULL FROM r"""
_WORDS = "regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[\\p{L}\\p{N}]+')"
_EDGES = "SELECT DISTINCT amendment_document_id AS from_document, document_id AS to_document, 'AMENDS' AS relation FROM legal_document_versions WHERE amendment_document_id IS NOT NULL"


def _tri(x: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"



def _question(query: str, where: str, covers: str = "true") -> str:
    """The scores of a question: places of its words, shortest spans, trigrams of titles and texts."""
    terms = S._terms(query)
    last = [f"max(CASE WHEN w = '{t}' THEN i END) OVER o" for t in terms]
    ratio = "coalesce(len(list_intersect({0}, q)) / nullif(len({0}) + len(q) - len(list_intersect({0}, q)), 0), 0)"
    return f"""WITH {_N}, w AS (SELECT id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS i FROM n), h AS (SELECT * FROM w WHERE w IN ({", ".join(repr(t) for t in terms)})),
a AS (SELECT id, i, {", ".join(f"{e} AS p{k}" for k, e in enumerate(last))} FROM h WINDOW o AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT id, i, CASE WHEN {" + ".join(f"p{k}" for k in range(len(terms)))} IS NOT NULL THEN least({", ".join(f"p{k}" for k in range(len(terms)))}) END AS start FROM a),
c AS (SELECT *, lag(start) OVER (PARTITION BY id ORDER BY i) AS before FROM b),
e AS (SELECT id, sum(0.1 :: DOUBLE / (1 + (i - start + 1 - {len(terms)}))) AS density FROM c WHERE start IS NOT NULL AND (before IS NULL OR start > before) GROUP BY 1),
g AS (SELECT n.id, n.document_version_id, source_locator, title, {_tri("coalesce(title, '')")} AS tt, {_tri("coalesce(text, '')")} AS xt, {_tri(repr(query))} AS q, density FROM n LEFT JOIN e USING (id)),
s AS (SELECT *, {ratio.format("tt")} AS ts, {ratio.format("xt")} AS xs FROM g),
v AS (SELECT DISTINCT id AS document_version_id, document_id, effective_from, effective_to FROM legal_document_versions WHERE {where}),
t AS (SELECT *, coalesce(density, 0) + 0.3 :: DOUBLE * xs + 0.8 :: DOUBLE * ts AS score FROM s JOIN v USING (document_version_id) WHERE density IS NOT NULL OR ts >= 0.3 ORDER BY score DESC, id LIMIT 20)
SELECT document_id, source_locator, arg_max(id, (score, id)) AS id, arg_max(document_version_id, (score, id)) AS document_version_id, arg_max(struct_pack(title), (score, id)).title AS title, round(max(score), 9) AS score FROM t WHERE {covers} GROUP BY 1, 2"""


_SIM = f"round(coalesce(len(list_intersect(t, q)) / nullif(len(t) + len(q) - len(list_intersect(t, q)), 0), 0), 6)"

ORACLE = {
    "retrieve_authorities": f"WITH {_N}, {_D}, {_V} SELECT n.id AS node_id, v.document_id, n.document_version_id, coalesce(n.title, 'Article ' || nullif(article, ''), source_locator) AS title, substring(text, 1, 500) AS excerpt, source_locator AS locator, d.title AS document_title FROM n JOIN v ON v.id = n.document_version_id LEFT JOIN d ON d.id = v.document_id",
    "citation_index": f"WITH {_N}, {_D}, {_V} {_INDEX}",
    "citation_backfill": f"WITH {_N}, a AS (SELECT document_version_id, count(*) AS n_nodes FROM n WHERE node_type <> 'DOCUMENT' GROUP BY 1), c AS (SELECT document_version_id, count(DISTINCT id) AS k FROM citation_entries GROUP BY 1) SELECT document_version_id, n_nodes, coalesce(k, 0) AS n_citations, n_nodes = coalesce(k, 0) AS complete FROM a LEFT JOIN c USING (document_version_id)",
    "missing_citations": f"WITH {_N} SELECT id, document_version_id FROM n WHERE node_type <> 'DOCUMENT' AND NOT EXISTS (SELECT 1 FROM citation_entries c WHERE c.legal_node_id = n.id AND c.document_version_id = n.document_version_id)",
    "verify_batch": f"WITH {_N}, {_NOW}, {_verdicts(_ASK)} SELECT * FROM w",
    "verify_batch_asof": f"WITH {_N}, {_THEN}, {_verdicts(_ASK, ',as_of_unavailable')} SELECT * FROM w",
    "verify_phrases": f"WITH {_N}, {_NOW}, {_verdicts(_PHRASES)} SELECT * FROM w",
    "verify_candidates": f"WITH {_N}, {_NOW}, {_verdicts(_CANDIDATES)} SELECT * FROM w",
    "retrieve_citations_batch": f"WITH {_N}, {_NOW}, {_matches(_ASK)}, o AS (SELECT document_version_id, legal_node_id, unnest(arg_min(struct_pack(locator, title, exact_text), (citation_key, locator, title, exact_text))) FROM pub GROUP BY 1, 2) SELECT candidate_id, document_version_id, legal_node_id, coalesce(title, locator) AS title, substring(exact_text, 1, 500) AS excerpt FROM m JOIN o USING (document_version_id, legal_node_id)",
    "relation_edges": _EDGES,
    "relation_scope": f"WITH e AS ({_EDGES}), r AS (SELECT id FROM legal_documents WHERE status = 'REPEALED') SELECT * FROM e WHERE from_document IN (SELECT id FROM r) OR to_document IN (SELECT id FROM r)",
    "fts_candidates": f"WITH {_N} SELECT id, document_version_id, source_locator FROM n WHERE list_has_all({_WORDS}, ['хууль', 'хяналт', 'гэрээ'])",
    "fts_websearch": f"WITH {_N} SELECT id, source_locator FROM n WHERE contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' нийт хууль ') OR (list_contains({_WORDS}, 'хариуцлага') AND NOT list_contains({_WORDS}, 'татвар'))",
    "trigram_titles": f"WITH x AS (SELECT DISTINCT id, title FROM legal_documents), y AS (SELECT id, title, {_tri('title')} AS t, {_tri(repr(QUESTION))} AS q FROM x) SELECT id, title, {_SIM} AS sim FROM y WHERE {_SIM} > 0",
    "trigram_title_topk": f"WITH {_N}, y AS (SELECT id, title, {_tri('title')} AS t, {_tri(repr(QUESTION))} AS q FROM n WHERE title IS NOT NULL) SELECT id, title, {_SIM} AS sim FROM y WHERE {_SIM} >= 0.3 ORDER BY sim DESC, id LIMIT 20",
    "open_question": _question(QUESTION, "status = 'PUBLISHED'"),
    "open_question_asof": _question(QUESTION, "status IN ('PUBLISHED', 'SUPERSEDED')", "effective_from <= TIMESTAMP '2015-06-01' AND TIMESTAMP '2015-06-01' < effective_to"),
    "open_question_scan": _question(TERMS, "status = 'PUBLISHED'"),
    "index_postings": f"WITH {_N}, w AS (SELECT id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) - 1 AS place FROM n) SELECT term, count(DISTINCT id) AS n_nodes, count(*) AS n_places, max(place) AS last_place FROM w GROUP BY 1",
    "token_overlap_score": "WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), y AS (SELECT doc_id, " + " + ".join(f"contains(t, '{w}') :: INT" for w in [*QUESTION.split(), QUESTION]) + " AS score FROM x) SELECT * FROM y WHERE score > 0",
    "parse_citation": f"WITH c AS (SELECT DISTINCT id, {_spaced('exact_text')} AS q FROM citation_entries), p AS (SELECT id, {_parsed('q')} FROM c) SELECT id, article, paragraph, {_LOC} AS locator, title_hint FROM p WHERE article IS NOT NULL",
}
