"""Outward calls: verify a batch of citations, retrieve authorities. Both give DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.operators import retrieval, search
from lexcorpus.operators.audit import nodes_once
from lexcorpus.operators.versions import covers
from lexcorpus.tables import records

MAX_CITATIONS, MAX_QUESTION, MAX_AUTHORITIES = 50, 8000, 100


@dataclass
class Corpus:
    """The tables that requests are answered from."""

    nodes: DataFrame
    versions: DataFrame
    documents: DataFrame
    citations: DataFrame
    index: search.Index | None = None  # of the nodes; without one a question scans them


@dataclass(frozen=True)
class Request:
    """What is looked for; the first field given, in this order, decides. A citation is a phrase, or a phrase and a node id."""

    node_id: str | None = None
    document_id: str | None = None
    citation_key: str | None = None
    locator: str | None = None
    citations: tuple[str | tuple[str, str | None], ...] = ()
    question: str | None = None
    as_of: str | None = None

    def __post_init__(self):
        if len(self.citations) > MAX_CITATIONS:
            raise ValueError(f"at most {MAX_CITATIONS} citations")
        if not all(c[0] if isinstance(c, tuple) else c for c in self.citations):
            raise ValueError("a citation has at least one character")
        if self.question is not None and not 1 <= len(self.question) <= MAX_QUESTION:
            raise ValueError(f"a question has 1 to {MAX_QUESTION} characters")


def clamp_limit(limit: int, needed: int, cap: int) -> int:
    """How many acts a run takes: what is asked or needed, within 1 and ``cap``."""
    return max(1, min(max(limit, needed), cap))


def verify(corpus: Corpus, candidates: DataFrame, as_of: str | None = None) -> DataFrame:
    """(candidate_id, verdict, document_version_id, legal_node_id, reasons) for every candidate."""
    public = retrieval.public_citations(corpus.citations, corpus.nodes, corpus.versions, as_of)
    return retrieval.verify(candidates, public, corpus.documents).withColumn("reasons", retrieval.reasons(F.col("verdict"), as_of is not None))


def _cited(corpus: Corpus, asked: list[tuple], as_of: str | None) -> DataFrame:
    """Authorities that (candidate_id, query, node_id, locator, citation_key) name, with the titles of their documents."""
    candidates = corpus.nodes.sparkSession.createDataFrame(asked, "candidate_id int, query string, node_id string, locator string, citation_key string")
    public = retrieval.public_citations(corpus.citations, corpus.nodes, corpus.versions, as_of)
    titles = records(corpus.documents, "id", ["title"], ["updated_at"]).select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    found = retrieval.retrieve_batch(candidates, public, corpus.documents).join(titles, "document_id", "left")
    return found.select("candidate_id", F.col("legal_node_id").alias("node_id"), "document_id", "document_version_id", "title", "excerpt", "locator", "document_title")


def retrieve(corpus: Corpus, request: Request) -> tuple[DataFrame, str]:
    """(authorities, status): ``ok``, or ``AS_OF_UNAVAILABLE`` if nothing is known to have been in force then."""
    found = retrieval.authorities(corpus.nodes, corpus.versions, corpus.documents)
    at = request.as_of
    if request.node_id:
        rows = found.where(F.col("node_id") == request.node_id)  # whatever its version's status
    else:
        if request.document_id:
            from lexcorpus.operators.versions import as_of, current

            v = as_of(corpus.versions, at) if at else current(corpus.versions)
            rows = found.join(v.where(F.col("document_id") == request.document_id).select(F.col("id").alias("document_version_id")), "document_version_id", "left_semi")
        elif request.citation_key or request.locator:
            rows = _cited(corpus, [(0, request.citation_key or request.locator, None, request.locator, request.citation_key)], at)
        elif request.citations:
            rows = _cited(corpus, [(i, *(c if isinstance(c, tuple) else (c, None)), None, None) for i, c in enumerate(request.citations)], at)
        elif request.question and request.question.strip():
            if corpus.index:
                best = search.open_question_indexed(corpus.index, corpus.versions, request.question, at)
            else:
                best = search.open_question(nodes_once(corpus.nodes), corpus.versions, request.question, at)
            rows = found.join(best.select(F.col("id").alias("node_id"), "score"), "node_id")
        else:
            rows = found.limit(0)
    if at and not request.node_id:
        rows = rows.join(corpus.versions.where(covers(at)).select(F.col("id").alias("document_version_id")).distinct(), "document_version_id", "left_semi")
    # the best first where there is a score, else by version and place
    order = [c for c in ("candidate_id",) if c in rows.columns] + (["score"] if "score" in rows.columns else ["document_version_id", "locator"])
    rows = rows.orderBy(*[F.desc(c) if c == "score" else c for c in order], "node_id").drop("score", "candidate_id").limit(MAX_AUTHORITIES)
    status = "AS_OF_UNAVAILABLE" if at and rows.isEmpty() else "ok"
    return rows, status
