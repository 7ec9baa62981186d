"""Structural and referential audits of the corpus, as aggregates and equi-joins.

Rows delivered twice count once unless an operator looks for them. Lists of offenders are bounded
samples; counts are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexcorpus.functions.urls import law_id
from lexcorpus.tables import BLANKS, records, stripped

#: Which parent types each node type may have (fixed values); none: must be a root.
ALLOWED_PARENTS = {
    "DOCUMENT": [],
    "BOOK": ["DOCUMENT"],
    "PART": ["DOCUMENT", "BOOK"],
    "CHAPTER": ["DOCUMENT", "PART"],
    "SECTION": ["CHAPTER", "PART", "DOCUMENT"],
    "ARTICLE": ["DOCUMENT", "CHAPTER", "SECTION"],
    "PARAGRAPH": ["ARTICLE"],
    "CLAUSE": ["PARAGRAPH"],
    "SUB_CLAUSE": ["CLAUSE"],
    "ANNEX": ["DOCUMENT", "CHAPTER"],
}
#: The form of a locator (fixed value).
LOCATOR = r"^(doc|ch-[0-9]+(\^[0-9]+)?|art-[0-9]+(\.[0-9]+)?(\^[0-9]+)?(/p-[0-9]+(/c-[0-9]+(/sc-[0-9]+)?)?)?|annex-[0-9]+)$"

NODE = ["document_version_id", "parent_id", "node_type", "chapter", "article", "title", "text", "source_locator", "content_hash"]


def nodes_once(nodes: DataFrame, columns: list[str] = NODE) -> DataFrame:
    """One row per node id: the copy updated last. Only ``columns`` are read and shuffled."""
    return records(nodes.where("id is not null"), "id", list(columns), ["updated_at"])


PLACE = ["document_version_id", "parent_id", "node_type", "source_locator"]


def allowed_parent(child: Column, parent: Column) -> Column:
    """Whether ``parent`` (null: none) is a type that ``child`` may hang under; unknown types may not."""
    pairs = F.array(*[F.lit(f"{c}<{p}") for c, ps in ALLOWED_PARENTS.items() for p in ps])
    roots = [c for c, ps in ALLOWED_PARENTS.items() if not ps]
    return F.when(parent.isNull(), F.coalesce(child.isin(roots), F.lit(False))).otherwise(F.coalesce(F.array_contains(pairs, F.concat(child, F.lit("<"), parent)), F.lit(False)))


def assign_locators(articles: DataFrame) -> DataFrame:
    """(id, document_id, source_locator, collides): unique locators of legacy articles.

    The base is article-<number>, or the position where the number is null (an empty number stays).
    The first of a base by (position, id) keeps it; the others get their id appended. The first
    comes from an aggregate, not from a window over the group.
    """
    rows = articles.select("id", "document_id", "ord", F.concat(F.lit("article-"), F.coalesce("article_number", F.col("ord").cast("string"))).alias("base")).distinct()
    first = rows.groupBy("document_id", "base").agg(F.min(F.struct("ord", "id")).alias("first"), F.count(F.lit(1)).alias("n"))
    keeps = F.col("id") == F.col("first.id")
    return rows.join(first, ["document_id", "base"]).select("id", "document_id", F.when(keeps, F.col("base")).otherwise(F.concat("base", F.lit("__legacyId-"), "id")).alias("source_locator"), (F.col("n") > 1).alias("collides"))


def locator_collisions(articles: DataFrame) -> DataFrame:
    """(document_id, article_number, n_rows, excess, same_text, same_title, winner_id) of numbers used more than once in a document."""
    rows = articles.where("article_number is not null").select("id", "document_id", "article_number", "ord", "text", "title").distinct()
    same = lambda c: F.min(F.sha2(F.coalesce(c, F.lit("")), 256)) == F.max(F.sha2(F.coalesce(c, F.lit("")), 256))
    stats = rows.groupBy("document_id", "article_number").agg(F.count(F.lit(1)).alias("n_rows"), same("text").alias("same_text"), same("title").alias("same_title"), F.min_by("id", F.struct("ord", "id")).alias("winner_id"))
    return stats.where("n_rows > 1").select("document_id", "article_number", "n_rows", (F.col("n_rows") - 1).alias("excess"), "same_text", "same_title", "winner_id")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of key values that several rows have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeats(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, id, first_id): every row (id) but the first in ``order`` of those with the same key; the first comes from an aggregate, not from a window over the group."""
    rows = df.select("id", *keys, *[c for c in order if c != "id"]).distinct()
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, F.col("id").alias("_id"))).alias("f"))
    return rows.join(first, keys).where("id <> f._id").select(*keys, "id", F.col("f._id").alias("first_id")).distinct()


def parent_report(nodes: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(id, document_version_id, source_locator, node_type, orphan, foreign_parent, invalid_parent, incompatible[, root, keep]): each node against its parent.

    The parent must be a node of the same version; a parent elsewhere is a foreign one. With ``keep``,
    other columns and whether the node has no parent come along.
    """
    n = nodes_once(nodes, [*PLACE, *keep])
    p = n.select(F.col("id").alias("up"), F.col("node_type").alias("p_type"), F.col("document_version_id").alias("p_version"))
    # roots get a key of their own: as null keys they would all meet in one task
    j = n.withColumn("up", F.coalesce("parent_id", F.concat(F.lit("\u0000"), "id"))).join(p, "up", "left")
    has, found = F.col("parent_id").isNotNull(), F.col("p_version").isNotNull()
    same = found & (F.col("p_version") == F.col("document_version_id"))
    orphan = has & ~F.coalesce(same, F.lit(False))
    return j.select(
        "id",
        "document_version_id",
        "source_locator",
        "node_type",
        orphan.alias("orphan"),
        (found & ~F.coalesce(same, F.lit(False))).alias("foreign_parent"),
        (orphan | (~has & ~allowed_parent(F.col("node_type"), F.lit(None).cast("string")))).alias("invalid_parent"),
        (F.coalesce(same, F.lit(False)) & ~allowed_parent(F.col("node_type"), F.coalesce("p_type", F.lit("")))).alias("incompatible"),
        *([(~has).alias("root"), *keep] if keep else []),
    )


def version_structure(nodes: DataFrame) -> DataFrame:
    """One row per version: counts of nodes, roots and offenders, and PASS or FAIL (circles: see hierarchy)."""
    s = parent_report(nodes.withColumn("__", F.lit(True)), ["__"]).groupBy("document_version_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if("orphan").alias("orphans"),
        F.count_if("invalid_parent").alias("invalid_parents"),
        F.count_if("incompatible").alias("incompatible_types"),
        (F.count(F.lit(1)) - F.countDistinct("source_locator")).alias("duplicate_locators"),
        F.count_if((F.col("node_type") == "DOCUMENT") & F.col("root")).alias("document_parents"),
    )
    ok = (F.col("document_parents") == 1) & (F.col("orphans") + F.col("invalid_parents") + F.col("incompatible_types") + F.col("duplicate_locators") == 0)
    return s.withColumn("result", F.when(ok, "PASS").otherwise("FAIL"))


def parse_shape(nodes: DataFrame) -> DataFrame:
    """One row per version: counts by node type, inserted articles and surplus locators."""
    n = nodes_once(nodes, [*PLACE, "article"])
    kind = lambda t: F.count_if(F.col("node_type") == t).alias(f"n_{t.lower()}")
    return n.groupBy("document_version_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        *[kind(t) for t in ("BOOK", "CHAPTER", "ARTICLE", "PARAGRAPH", "CLAUSE", "SUB_CLAUSE", "ANNEX")],
        F.count_if((F.col("node_type") == "ARTICLE") & F.contains("article", F.lit("^"))).alias("n_inserted"),
        (F.count(F.lit(1)) - F.countDistinct("source_locator")).alias("n_surplus_locators"),
    )


def citation_round_trip(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(citation_id, reason): every way in which a citation doesn't lead back to its node."""
    blank = lambda c: F.coalesce(stripped(F.col(c)), F.lit("")) == ""
    c = citations.select("id", "legal_node_id", "document_version_id", "locator", "exact_text", F.col("content_hash").alias("c_hash")).distinct()
    n = nodes_once(nodes, ["document_version_id", "source_locator", "text", "node_type", "content_hash"]).select(F.col("id").alias("legal_node_id"), F.col("document_version_id").alias("n_version"), "source_locator", "text", "node_type", F.col("content_hash").alias("n_hash"), F.lit(True).alias("found"))
    j = c.join(n, "legal_node_id", "left")
    found = F.col("found").isNotNull()
    text_types = ["ARTICLE", "PARAGRAPH", "CLAUSE", "SUB_CLAUSE"]
    reasons = F.array_compact(
        F.array(
            F.when(~found, "missing_node"),
            F.when(found & ~F.col("source_locator").eqNullSafe(F.col("locator")), "locator_mismatch"),
            F.when(found & ~F.col("n_version").eqNullSafe(F.col("document_version_id")), "version_mismatch"),
            F.when(found & F.col("node_type").isin(text_types) & blank("text"), "empty_source_text"),
            F.when(found & blank("exact_text"), "empty_citation_text"),
            F.when(found & (blank("c_hash") | blank("n_hash")), "missing_content_hash"),
        )
    )
    return j.select(F.col("id").alias("citation_id"), F.explode(reasons).alias("reason"))


def data_quality(nodes: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """(problem, n): complete counts of the problems of the corpus."""
    n = nodes_once(nodes, ["document_version_id", "source_locator", "text"])
    v = versions.select("id", "document_id", "version_number").distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    parts = [
        one(duplicate_keys(n, ["document_version_id", "source_locator"]), "duplicate_locators"),
        one(n.where(~F.coalesce(F.rlike("source_locator", F.lit(LOCATOR)), F.lit(False))), "malformed_locators"),
        one(n.where(F.coalesce(F.regexp_replace("text", f"[{BLANKS}]", ""), F.lit("")) == ""), "empty_texts"),
        one(v.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti"), "versions_without_document"),
        one(duplicate_keys(v, ["document_id", "version_number"]), "duplicate_version_numbers"),
        one(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "nodes_delivered_twice"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def offenders(nodes: DataFrame, sample: int = 5) -> DataFrame:
    """(problem, n, sample): how many nodes have a problem, and the smallest ``sample`` ids of them."""
    n = nodes_once(nodes, ["source_locator", "title", "text"])
    text = F.coalesce(F.regexp_replace("text", f"[{BLANKS}]", ""), F.lit(""))
    found = n.select("id", F.explode(F.array_compact(F.array(F.when(text == "", "empty_text"), F.when(F.col("title").isNull(), "no_title"), F.when(~F.coalesce(F.rlike("source_locator", F.lit(LOCATOR)), F.lit(False)), "malformed_locator")))).alias("problem"))
    counts = found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    # the smallest ids of each bucket first: no group is gathered as a whole
    bucket = found.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(64)))
    for group in (["problem", "b"], ["problem"]):
        w = Window.partitionBy(*group).orderBy("id")
        bucket = bucket.withColumn("r", F.row_number().over(w)).where(f"r <= {sample}").drop("r")
    few = bucket.groupBy("problem").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample"))
    return counts.join(few, "problem")


def unknown_locators(documents: DataFrame, versions: DataFrame, nodes: DataFrame, probes: list[str]) -> DataFrame:
    """(document_id, locator, status): each document probed for locators that should not exist.

    ``probes`` is a short constant list, joined to every document as an array.
    """
    d = documents.select(F.col("id").alias("document_id")).distinct().select("document_id", F.explode(F.array(*map(F.lit, probes))).alias("locator"))
    owner = versions.select(F.col("id").alias("document_version_id"), "document_id").distinct()
    hits = nodes.where(F.col("source_locator").isin(probes)).select("document_version_id", F.col("source_locator").alias("locator")).distinct().join(owner, "document_version_id").groupBy("document_id", "locator").agg(F.count(F.lit(1)).alias("n"))
    return d.join(hits, ["document_id", "locator"], "left").select("document_id", "locator", F.when(F.col("n").isNull(), "UNRESOLVED").when(F.col("n") == 1, "VALID").otherwise("CONFLICT").alias("status"))


def expected_locators(documents: DataFrame, versions: DataFrame, nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """(law_id, locator, status): whether the published version of a law has a locator it should have: VALID, AMBIGUOUS if several nodes have it, else UNRESOLVED.

    ``expected`` (law_id, locator); a law is known by the number in its address.
    """
    d = records(documents, "id", ["canonical_url"], ["updated_at"]).select(F.col("id").alias("document_id"), law_id(F.col("canonical_url")).alias("law_id"))
    v = versions.where("status = 'PUBLISHED'").select(F.col("id").alias("document_version_id"), "document_id").distinct()
    e = expected.select("law_id", "locator").distinct()
    n = nodes_once(nodes, ["document_version_id", "source_locator"]).select("document_version_id", F.col("source_locator").alias("locator"))
    hits = e.join(d, "law_id").join(v, "document_id").join(n, ["document_version_id", "locator"]).groupBy("law_id", "locator", "document_version_id").agg(F.count(F.lit(1)).alias("n")).groupBy("law_id", "locator").agg(F.max("n").alias("n"))
    return e.join(hits, ["law_id", "locator"], "left").select("law_id", "locator", F.when(F.col("n").isNull(), "UNRESOLVED").when(F.col("n") == 1, "VALID").otherwise("AMBIGUOUS").alias("status"))
