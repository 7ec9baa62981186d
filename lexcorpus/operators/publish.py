"""The next state of versions after a publication, legacy migration, and comparisons of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.operators.audit import assign_locators, nodes_once
from lexcorpus.operators.hierarchy import hierarchy
from lexcorpus.operators.versions import succession
from lexcorpus.tables import records, stripped

STATE = ["id", "document_id", "version_number", "effective_from", "effective_to", "content_hash", "parser_id", "status"]


def publish(versions: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """STATE and decision: ``versions`` after publishing ``incoming`` (document_id, content_hash, parser_id, effective_from), at most one a document.

    The same bytes and parser change nothing. The same bytes by another parser are a
    canonicalization: published versions are superseded with their bounds kept, the new one starts
    at an unknown time. Other bytes are a source update: what was published ends now unless it
    had an end.
    """
    v = versions.select(*STATE).distinct()
    new = incoming.groupBy("document_id").agg(F.max(F.struct("content_hash", "parser_id", "effective_from")).alias("n")).select("document_id", F.col("n.content_hash").alias("n_hash"), F.col("n.parser_id").alias("n_parser"), F.col("n.effective_from").alias("n_from"))
    seen = v.join(new, "document_id").groupBy("document_id").agg(F.max("version_number").alias("top"), F.bool_or(F.col("content_hash") == F.col("n_hash")).alias("same"), F.bool_or((F.col("content_hash") == F.col("n_hash")) & (F.col("parser_id") == F.col("n_parser"))).alias("both"))
    decision = F.when(F.col("top").isNull(), "new_document").when(F.col("both"), "unchanged").when(F.col("same"), "canonicalization").otherwise("source_update")
    decided = new.join(seen, "document_id", "left").withColumn("decision", decision)
    at = F.lit(now).cast("timestamp_ntz")
    old = v.join(decided.select("document_id", "decision"), "document_id", "left")
    replaced = (F.col("status") == "PUBLISHED") & F.coalesce(F.col("decision").isin("canonicalization", "source_update"), F.lit(False))
    old = old.select(
        *STATE[:4],
        F.when(replaced & (F.col("decision") == "source_update"), F.coalesce("effective_to", at)).otherwise(F.col("effective_to")).alias("effective_to"),
        "content_hash",
        "parser_id",
        F.when(replaced, "SUPERSEDED").otherwise(F.col("status")).alias("status"),
        F.lit("kept").alias("decision"),
    )
    number = F.coalesce("top", F.lit(0)) + 1
    made = decided.where("decision <> 'unchanged'").select(
        F.sha2(F.concat_ws("|", "document_id", number.cast("string")), 256).alias("id"),
        "document_id",
        number.alias("version_number"),
        F.when(F.col("decision") != "canonicalization", F.col("n_from")).alias("effective_from"),
        F.lit(None).cast("timestamp_ntz").alias("effective_to"),
        F.col("n_hash").alias("content_hash"),
        F.col("n_parser").alias("parser_id"),
        F.lit("PUBLISHED").alias("status"),
        "decision",
    )
    return old.unionByName(made)


def migrate(documents: DataFrame, articles: DataFrame, archives: DataFrame, kind: Column) -> DataFrame:
    """(document_id, outcome, document_type, n_nodes, first_locator): what becomes of each legacy document.

    A document without its archive is rejected, one without articles is migrated with its root only.
    """
    a = archives.select(F.lower(stripped(F.col("id"))).alias("key"), F.lit(True).alias("there")).distinct()
    d = documents.groupBy("id").agg(F.max(F.struct(F.lower(stripped(F.col("archive_id"))).alias("key"), kind.alias("document_type"))).alias("d")).select(F.col("id").alias("document_id"), "d.key", "d.document_type")
    n = assign_locators(articles).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min("source_locator").alias("first_locator"))
    j = d.join(a, "key", "left").join(n, "document_id", "left")
    migrated = F.col("there").isNotNull()
    return j.select("document_id", F.when(migrated, "migrated").otherwise("no_matching_archive").alias("outcome"), "document_type", F.when(migrated, F.coalesce("n", F.lit(0)) + 1).otherwise(0).alias("n_nodes"), F.when(migrated, F.col("first_locator")).alias("first_locator"))


def migrated_rows(documents: DataFrame, articles: DataFrame, archives: DataFrame, kind: Column) -> dict[str, DataFrame]:
    """The rows that :func:`migrate` makes of the documents it accepts: ``sources``, ``documents``, ``versions``, ``nodes``, ``audit``.

    Ids are hashes of the legacy ids, so running it again gives the same rows. Bounds of versions are
    unknown. A root node and one article for each legacy article make the tree; ``audit`` says what became of each document.
    """
    made = lambda mark, c: F.sha2(F.concat(F.lit(f"{mark}|"), c), 256)
    outcome = migrate(documents, articles, archives, kind)
    key = F.lower(stripped(F.col("archive_id")))
    d = records(documents.where("id is not null"), "id", ["title", "law_id", "source_url", "jurisdiction", "content_sha256", "archive_id"], ["ingested_at"])
    d = d.join(outcome.where("outcome = 'migrated'").select(F.col("document_id").alias("id"), "document_type"), "id")
    a = archives.where("id is not null").groupBy(F.lower(stripped(F.col("id"))).alias("key")).agg(F.max(F.struct("fetched_at", "authority", "source_type", "jurisdiction")).alias("a"))
    sources = d.select(key.alias("key")).distinct().join(a, "key").select("a.authority", "a.source_type", "a.jurisdiction").distinct()
    nothing = F.lit(None).cast("timestamp_ntz")
    out_documents = d.select(made("d", F.col("id")).alias("id"), F.col("id").alias("legacy_id"), "document_type", "title", F.col("law_id").alias("document_number"), "jurisdiction", F.col("source_url").alias("canonical_url"), F.lit("IN_FORCE").alias("status"))
    versions = d.select(
        made("v", F.col("id")).alias("id"), made("d", F.col("id")).alias("document_id"), F.lit(1).alias("version_number"), nothing.alias("effective_from"), nothing.alias("effective_to"), F.col("content_sha256").alias("content_hash"), F.lit("legacy-import").alias("parser_id"), F.lit("PUBLISHED").alias("status"), key.alias("archive_record_id")
    )
    roots = d.select(made("r", F.col("id")).alias("id"), made("v", F.col("id")).alias("document_version_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("DOCUMENT").alias("node_type"), F.lit(None).cast("string").alias("article"), "title", F.col("title").alias("text"), F.lit("doc").alias("source_locator"))
    text = records(articles.where("id is not null"), "id", ["text", "title", "article_number"]).select(F.col("id"), "text", "title", "article_number")
    placed = assign_locators(articles).select("id", "document_id", "source_locator").join(d.select(F.col("id").alias("document_id")), "document_id", "left_semi").join(text, "id")
    leaves = placed.select(made("n", F.concat_ws("|", "document_id", "id")).alias("id"), made("v", F.col("document_id")).alias("document_version_id"), made("r", F.col("document_id")).alias("parent_id"), F.lit("ARTICLE").alias("node_type"), F.col("article_number").alias("article"), "title", "text", "source_locator")
    nodes = roots.unionByName(leaves).withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    audit = outcome.select(F.col("document_id").alias("legacy_id"), F.when(F.col("outcome") == "migrated", made("d", F.col("document_id"))).alias("entity_id"), F.lit("legacy_backfill").alias("action"), "outcome")
    return {"sources": sources, "documents": out_documents, "versions": versions, "nodes": nodes, "audit": audit}


def locator_changes(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, replaces_id, n_missing, n_unexpected): locators a version lost and gained against the one before it."""
    pairs = succession(versions).where("replaces_id is not null").select("id", "replaces_id")
    n = nodes_once(nodes, ["document_version_id", "source_locator"]).select("document_version_id", "source_locator").distinct()
    now = pairs.join(n, F.col("id") == F.col("document_version_id")).select("id", "replaces_id", "source_locator", F.lit(1).alias("now"), F.lit(0).alias("then"))
    then = pairs.join(n, F.col("replaces_id") == F.col("document_version_id")).select("id", "replaces_id", "source_locator", F.lit(0).alias("now"), F.lit(1).alias("then"))
    each = now.unionByName(then).groupBy("id", "replaces_id", "source_locator").agg(F.max("now").alias("now"), F.max("then").alias("then"))
    return each.groupBy("id", "replaces_id").agg(F.count_if(F.col("now") == 0).alias("n_missing"), F.count_if(F.col("then") == 0).alias("n_unexpected"))


def preorder(nodes: DataFrame) -> DataFrame:
    """(node_id, depth, place): sorting by ``place`` gives parents before their children and siblings by (created_at, id)."""
    n = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", "parent_id")).alias("u"), F.min("created_at").alias("created_at")).select("id", F.col("u.parent_id").alias("parent_id"), "created_at")
    key = lambda t, i: F.concat(F.date_format(t, "yyyyMMddHHmmssSSSSSS"), F.lit("-"), i)
    up = n.select(F.col("id").alias("parent_id"), key(F.col("created_at"), F.col("id")).alias("parent_key"))
    keyed = n.join(up, "parent_id", "left").select("id", key(F.col("created_at"), F.col("id")).alias("key"), "parent_key")
    walked = hierarchy(keyed, "key", "parent_key").where("depth >= 0")
    return walked.select(F.regexp_extract("node_id", "-(.*)$", 1).alias("node_id"), "depth", F.array_join("path", "/").alias("place"))


def cascade(nodes: DataFrame, doomed: DataFrame) -> DataFrame:
    """(node_id): what goes with the nodes ``doomed`` (id): they and everything below them."""
    ids = doomed.select("id").distinct()
    walked = hierarchy(nodes, newest=["updated_at"]).where("path is not null")
    # only trees with a doomed node are spread out
    trees = walked.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select("root_id").distinct()
    below = walked.join(trees, "root_id", "left_semi").select("node_id", F.explode("path").alias("id")).join(ids, "id", "left_semi").select("node_id")
    return below.unionByName(doomed.select(F.col("id").alias("node_id"))).distinct()


def node_violations(nodes: DataFrame) -> DataFrame:
    """(id, violations): blank locators or hashes, and ids delivered for several versions."""
    blank = lambda c: F.coalesce(stripped(F.col(c)), F.lit("")) == ""
    n = nodes.where("id is not null").groupBy("id").agg(F.bool_or(blank("source_locator")).alias("locator"), F.bool_or(blank("content_hash")).alias("hash"), (F.min("document_version_id") != F.max("document_version_id")).alias("several"), (F.count(F.lit(1)) > 1).alias("repeated"))
    checks = F.array_compact(F.array(F.when(F.col("locator"), "blank_locator"), F.when(F.col("hash"), "blank_hash"), F.when(F.col("several"), "several_versions"), F.when(F.col("repeated"), "delivered_twice")))
    return n.select("id", F.array_join(checks, ",").alias("violations")).where("violations <> ''")


def latest_editions(documents: DataFrame) -> DataFrame:
    """(law_id, id, version_no, n_editions): the newest edition of every known number."""
    d = documents.select("id", "law_id", "version_no").distinct().where("trim(law_id) not in ('', '0')")
    best = d.groupBy(F.trim("law_id").alias("law_id")).agg(F.max(F.struct("version_no", "id")).alias("b"), F.count(F.lit(1)).alias("n_editions"))
    return best.select("law_id", "b.id", "b.version_no", "n_editions")
