"""Archive, merge, publish and reconcile: batch forms of the write paths.

All are keyed joins and partial aggregates over whole tables that give the next state of a table;
``sources.snapshot`` writes such a state so that readers see all of it or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.functions.payload import archive_key
from lexcorpus.operators.audit import LOCATOR, PLACE, assign_locators, nodes_once, parent_report
from lexcorpus.tables import records, stripped

#: Nodes that are only controls of the page (fixed value).
CHROME_ONLY = r"(?i)^(хэвлэх|pdf|word|сонсох(?:\s*/\s*сонгосон.*)?|хуваалцах|-->)$"


def put_if_absent(payloads: DataFrame, key: str, text: str, catalogue: DataFrame | None = None) -> DataFrame:
    """(sha256, first_key, n_payloads, storage_key, byte_size): distinct payloads not in ``catalogue`` (sha256) yet; the first key wins, empty payloads are refused."""
    rows = payloads.where(F.coalesce(F.length(text), F.lit(0)) > 0).select(F.col(key).alias("k"), F.sha2(F.col(text), 256).alias("sha256"), F.octet_length(text).alias("byte_size"))
    found = rows.groupBy("sha256").agg(F.min("k").alias("first_key"), F.countDistinct("k").alias("n_payloads"), F.max("byte_size").alias("byte_size"))
    if catalogue is not None:
        found = found.join(catalogue.select("sha256").distinct(), "sha256", "left_anti")
    return found.select("sha256", "first_key", "n_payloads", archive_key(F.col("sha256")).alias("storage_key"), "byte_size")


def reuse(archives: DataFrame) -> DataFrame:
    """(id, sha256, reused, kept_mime, mime_differs): archive rows beside the first row of their hash."""
    a = archives.select("id", "sha256", "mime_type", "fetched_at").distinct()
    first = a.groupBy("sha256").agg(F.min(F.struct("fetched_at", "id", "mime_type")).alias("f"))
    return a.join(first, "sha256").select("id", "sha256", (F.col("id") != F.col("f.id")).alias("reused"), F.col("f.mime_type").alias("kept_mime"), (~F.col("mime_type").eqNullSafe(F.col("f.mime_type"))).alias("mime_differs"))


def integrity(archives: DataFrame) -> DataFrame:
    """(id, problem): archive rows whose key, size or checksum flag contradicts their hash."""
    key = archive_key(F.col("sha256"))
    checks = F.array_compact(
        F.array(
            F.when(key.isNull(), "bad_hash"),
            F.when(~F.col("storage_key").eqNullSafe(key), "key_mismatch"),
            F.when(F.coalesce(F.col("byte_size"), F.lit(0)) <= 0, "empty"),
            F.when(~F.coalesce("checksum_verified", F.lit(False)), "unverified"),
        )
    )
    return archives.select("id", F.explode(checks).alias("problem")).distinct()


def classify(incoming: DataFrame, known: DataFrame, key: list[str], checksum: str) -> DataFrame:
    """``key`` and outcome of each incoming key: inserted, updated (another checksum) or duplicate. Keys compare null-safe."""
    new = incoming.groupBy(*key).agg(F.max(checksum).alias("new_sum"))
    old = known.select(*[F.col(k).alias(f"o_{k}") for k in key], F.col(checksum).alias("o_sum")).distinct()
    there = old.drop("o_sum").distinct().withColumn("there", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in key]
    seen = new.join(there, on, "left").select(*key, "new_sum", "there")
    same = seen.join(old.withColumn("same", F.lit(True)), [*on, F.col("new_sum").eqNullSafe(F.col("o_sum"))], "left")
    outcome = F.when(F.col("there").isNull(), "inserted").when(F.col("same"), "duplicate").otherwise("updated")
    return same.select(*key, outcome.alias("outcome"))


def upsert(base: DataFrame, changes: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` put over those of the same key; repeated keys keep the greatest ``newest``."""
    cols = [c for c in base.columns if c != key]
    rank = [*newest, *[c for c in cols if c not in newest]]
    both = base.select(F.lit(0).alias("w"), *base.columns).unionByName(changes.select(F.lit(1).alias("w"), *base.columns))
    best = both.groupBy(key).agg(F.max(F.struct("w", *rank)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def insert_missing(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``base`` and the rows whose natural key it lacks; existing rows stay as they are. Keys compare null-safe."""
    there = base.select(*[F.col(k).alias(f"there_{k}") for k in key]).distinct()
    return base.unionByName(rows.select(*base.columns).join(there, [F.col(k).eqNullSafe(F.col(f"there_{k}")) for k in key], "left_anti"))


def replace_versions(base: DataFrame, rows: DataFrame, version: str = "document_version_id") -> DataFrame:
    """``base`` with all rows of the versions in ``rows`` replaced by ``rows``."""
    return base.join(rows.select(version).distinct(), version, "left_anti").select(*base.columns).unionByName(rows.select(*base.columns))


def replace_relations(relations: DataFrame, gone: DataFrame, kept: DataFrame) -> DataFrame:
    """``relations`` (from_node, to_node, ...) without those that touch a node of ``gone`` (id) that isn't in ``kept`` (id)."""
    lost = gone.select("id").distinct().join(kept.select("id").distinct(), "id", "left_anti")
    for end in ("from_node", "to_node"):
        relations = relations.join(lost.select(F.col("id").alias(end)), end, "left_anti").select(*relations.columns)
    return relations


def publish_decisions(versions: DataFrame) -> DataFrame:
    """(id, document_id, version_number, decision) of each version against those before it.

    The same bytes and parser: unchanged; the same bytes by another parser: canonicalization; other
    bytes: source_update; nothing before it: new_document.
    """
    v = versions.select("id", "document_id", "version_number", "content_hash", "parser_id").distinct()
    doc = v.groupBy("document_id").agg(F.min("version_number").alias("first"))
    by_hash = v.groupBy("document_id", "content_hash").agg(F.min("version_number").alias("hash_first"))
    by_both = v.groupBy("document_id", "content_hash", "parser_id").agg(F.min("version_number").alias("both_first"))
    j = v.join(doc, "document_id").join(by_hash, ["document_id", "content_hash"]).join(by_both, ["document_id", "content_hash", "parser_id"])
    n = F.col("version_number")
    decision = F.when(n == F.col("first"), "new_document").when(F.col("both_first") < n, "unchanged").when(F.col("hash_first") < n, "canonicalization").otherwise("source_update")
    return j.select("id", "document_id", "version_number", decision.alias("decision"))


def reconcile(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(citation_id, outcome): the first reason why a citation doesn't agree with its node, or matched."""
    c = citations.select("id", "legal_node_id", "document_version_id", "locator", "exact_text").distinct()
    n = nodes_once(nodes, ["document_version_id", "source_locator", "text"]).select(F.col("id").alias("legal_node_id"), F.col("document_version_id").alias("n_version"), "source_locator", "text", F.lit(True).alias("there"))
    outcome = (
        F.when(F.col("there").isNull(), "missing_node")
        .when(F.col("n_version") != F.col("document_version_id"), "other_version")
        .when(F.col("source_locator") != F.col("locator"), "other_locator")
        .when(~F.col("text").eqNullSafe(F.col("exact_text")), F.when(F.col("text").startswith(F.col("exact_text")), "shortened_text").otherwise("other_text"))
        .otherwise("matched")
    )
    return c.join(n, "legal_node_id", "left").select(F.col("id").alias("citation_id"), outcome.alias("outcome"))


def reconcile_migration(articles: DataFrame, migrated: DataFrame, nodes: DataFrame) -> DataFrame:
    """(article_id, document_id, expected_locator, outcome): legacy articles against the nodes made from them.

    ``migrated`` (legacy_id, document_version_id) says which version a legacy document became. The outcome is the first that holds of:
    document_not_found, missing (no node with the locator), other_text, other_number, matched.
    """
    a = assign_locators(articles).select(F.col("id").alias("article_id"), "document_id", F.col("source_locator").alias("expected_locator"))
    own = articles.groupBy(F.col("id").alias("article_id")).agg(F.max(F.struct("text", "article_number")).alias("a"))
    m = migrated.select(F.col("legacy_id").alias("document_id"), "document_version_id").distinct()
    n = nodes_once(nodes, ["document_version_id", "source_locator", "content_hash", "article"]).select("document_version_id", F.col("source_locator").alias("expected_locator"), "content_hash", "article", F.lit(True).alias("there"))
    j = a.join(own, "article_id").join(m, "document_id", "left").join(n, ["document_version_id", "expected_locator"], "left")
    outcome = (
        F.when(F.col("document_version_id").isNull(), "document_not_found")
        .when(F.col("there").isNull(), "missing")
        .when(~F.col("content_hash").eqNullSafe(F.sha2(F.coalesce("a.text", F.lit("")), 256)), "other_text")
        .when(~F.col("article").eqNullSafe(F.col("a.article_number")), "other_number")
        .otherwise("matched")
    )
    return j.select("article_id", "document_id", "expected_locator", outcome.alias("outcome"))


def archived_bytes(rows: DataFrame, archives: DataFrame, archive: str, sha256: str) -> DataFrame:
    """(id, expected_sha256, archive_sha256, ok): each row (id, ``archive``, ``sha256``) against the archive it names.

    An archive delivered several times has its latest hash; keys compare without surrounding blanks and case.
    """
    fold = lambda c: F.nullif(F.lower(stripped(F.col(c))), F.lit(""))
    a = archives.where(fold("id").isNotNull()).groupBy(fold("id").alias("key")).agg(F.max(F.struct("fetched_at", "sha256")).alias("a"))
    r = rows.select("id", fold(archive).alias("key"), F.col(sha256).alias("expected_sha256")).distinct()
    # rows without an archive get a key of their own: as null keys they would all meet in one task
    r = r.withColumn("key", F.coalesce("key", F.concat(F.lit("\u0000"), "id")))
    return r.join(a, "key", "left").select("id", "expected_sha256", F.col("a.sha256").alias("archive_sha256"), F.coalesce(F.col("a.sha256") == F.col("expected_sha256"), F.lit(False)).alias("ok"))


def shared_targets(citations: DataFrame) -> DataFrame:
    """(legal_node_id, n): nodes that more than one citation leads to; keys compare without surrounding blanks and case."""
    key = F.lower(stripped(F.col("legal_node_id")))
    return citations.select("id", key.alias("legal_node_id")).where("legal_node_id <> ''").distinct().groupBy("legal_node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lifecycle(events: DataFrame, job: str, kind: str, at: str, failure: str, done: str) -> DataFrame:
    """One row per job: first and last event, last kind, failures so far, finished or not; a fold by partial aggregates."""
    last = F.max_by(kind, F.struct(at, "event_id"))
    return events.groupBy(job).agg(F.min(at).alias("started_at"), F.max(at).alias("last_at"), last.alias("last_kind"), F.count_if(F.col(kind) == failure).alias("retry_count"), F.count(F.lit(1)).alias("n_events")).withColumn("finished", F.col("last_kind") == done)


def pending(documents: DataFrame, archives: DataFrame) -> DataFrame:
    """Documents whose archive isn't there."""
    a = archives.select(F.lower(stripped(F.col("id"))).alias("key")).distinct()
    return documents.select("id", F.lower(stripped(F.col("archive_id"))).alias("key")).distinct().join(a, "key", "left_anti").select("id")


def gate_facts(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per version with nodes: what :func:`confidence` and :func:`gate_reasons` judge by.

    The texts are reduced to marks where they are read; the nodes are de-duplicated once and
    meet their parents in one join.
    """
    blank = lambda c: F.coalesce(stripped(F.col(c)), F.lit(""))
    chrome = lambda c: F.rlike(blank(c), F.lit(CHROME_ONLY.replace("(?i)", "(?iu)")))
    inner = F.col("node_type") != "DOCUMENT"
    marks = {
        "has_text": inner & (blank("text") != ""),
        "chrome": inner & (chrome("text") | chrome("title")),
        "malformed": (F.col("node_type") == "ARTICLE") & F.coalesce("article", F.lit("0")).isin("", "0"),
        "invented": ~F.coalesce(F.rlike("source_locator", F.lit(LOCATOR)), F.lit(False)) | F.coalesce(F.col("chapter") == "0", F.lit(False)),
        "unsound": (blank("source_locator") == "") | (blank("content_hash") == ""),
    }
    r = parent_report(nodes.select("id", "updated_at", *PLACE, *[F.coalesce(c, F.lit(False)).alias(m) for m, c in marks.items()]), list(marks))
    facts = r.groupBy("document_version_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("node_type") == "ARTICLE").alias("articles"),
        F.countDistinct("source_locator").alias("locators"),
        F.countDistinct(F.when(inner, F.col("source_locator"))).alias("cited_locators"),
        F.count_if(inner).alias("cited"),
        F.count_if((F.col("node_type") == "DOCUMENT") & F.col("root")).alias("roots"),
        F.bool_or(F.col("node_type").isin("BOOK", "PART", "SECTION")).alias("levels"),
        F.bool_or("orphan").alias("orphan"),
        F.bool_or(F.col("invalid_parent") | F.col("incompatible")).alias("wrong"),
        *[F.bool_or(m).alias(m) for m in marks],
    )
    v = versions.groupBy(F.col("id").alias("document_version_id")).agg(F.min("document_id").alias("document_id"), F.max("effective_to").isNotNull().alias("ends"))
    return facts.join(v, "document_version_id", "left")


def _confidence_reasons() -> list[Column]:
    """Reasons against trusting a parse, in order; of :func:`gate_facts` with title and act_type."""
    broken = (F.col("locators") < F.col("nodes")) | F.col("orphan") | F.col("unsound")
    return [
        F.when((F.length(F.coalesce(F.trim("title"), F.lit(""))) < 3) | (F.col("title") == "Untitled"), "missing_title"),
        F.when(F.coalesce("act_type", F.lit("")) == "", "missing_act_type"),
        F.when(F.col("nodes").isNull(), "missing_version"),
        F.when(broken, "broken_article_hierarchy"),
        F.when(F.col("articles") == 0, "no_recognizable_provisions"),
        F.when(F.col("nodes") < 2, "suspiciously_low_node_count"),
        F.when(F.col("locators") < F.col("nodes"), "duplicate_locators"),
        F.when(F.col("malformed"), "malformed_numbering"),
        F.when(~F.col("has_text"), "empty_legal_text"),
    ]


def _acts(documents: DataFrame) -> DataFrame:
    return records(documents, "id", ["title", "document_type"], ["updated_at"]).select(F.col("id").alias("document_id"), "title", F.col("document_type").alias("act_type"))


def confidence(nodes: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, document_version_id, reasons): nine reasons against trusting the parse of a version, joined by commas, empty if there are none; acts without a version with nodes have a row without version."""
    facts = gate_facts(nodes, versions)
    j = _acts(documents).join(facts, "document_id", "left")
    return j.select("document_id", "document_version_id", F.array_join(F.array_compact(F.array(*_confidence_reasons())), ",").alias("reasons"))


def gate_reasons(nodes: DataFrame, versions: DataFrame, documents: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(document_version_id, reasons): all reasons against publishing a version, each once, in a fixed order, joined by commas; empty if there are none.

    ``hashes`` (document_version_id, archive_sha256, bytes_sha256): what is archived and what was parsed.
    """
    facts = gate_facts(nodes, versions).join(_acts(documents), "document_id", "left")
    if hashes is None:
        facts = facts.withColumn("other_bytes", F.lit(False))
    else:
        other = hashes.groupBy("document_version_id").agg(F.bool_or(~F.col("archive_sha256").eqNullSafe(F.col("bytes_sha256"))).alias("other_bytes"))
        facts = facts.join(other, "document_version_id", "left")
    own = [
        F.when(F.col("other_bytes"), "archive_hash_mismatch"),
        F.when(F.col("locators") < F.col("nodes"), "duplicate_locators"),
        F.when(F.col("orphan"), "orphan_nodes"),
        F.when(F.col("wrong"), "invalid_parent_relationships"),
        F.when(F.col("roots") != 1, "broken_article_hierarchy"),
        F.when(F.col("cited_locators") < F.col("cited"), "duplicate_citation_locators"),
        F.when(F.col("invented"), "invented_locator"),
        F.when(F.col("levels"), "invented_structural_level"),
        F.when(F.col("chrome"), "chrome_or_toc_node"),
        F.when(F.coalesce("ends", F.lit(False)), "unsafe_effective_to"),
    ]
    return facts.select("document_version_id", F.array_join(F.array_distinct(F.array_compact(F.array(*_confidence_reasons(), *own))), ",").alias("reasons"))


def rule_reasons(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(document_version_id, law_id, reason): rules of single acts that a version breaks.

    ``nodes``: rows of :func:`nodes_once` with law_id. ``rules`` (law_id, reason, check, argument, n) is a parameter table:
    ``locator`` wants a node whose locator matches the pattern ``argument``, ``text`` a text that does; ``least`` and ``most`` want so many
    nodes of the type ``argument``. Versions of acts without rules have no rows.
    """
    r = F.broadcast(rules.withColumn("rule", F.struct("reason", "check", "argument", "n")))
    met = F.when(F.col("rule.check") == "locator", F.expr("rlike(source_locator, rule.argument)")).when(F.col("rule.check") == "text", F.expr("rlike(text, rule.argument)")).otherwise(F.col("node_type") == F.col("rule.argument"))
    counted = nodes.join(r.select("law_id", "rule"), "law_id").groupBy("document_version_id", "law_id", "rule").agg(F.count_if(met).alias("k"))
    fits = F.when(F.col("rule.check") == "most", F.col("k") <= F.col("rule.n")).when(F.col("rule.check") == "least", F.col("k") >= F.col("rule.n")).otherwise(F.col("k") > 0)
    return counted.where(~fits).select("document_version_id", "law_id", "rule.reason").distinct()
