"""Documents, versions and nodes kept as one unit: a change of them is checked as a whole and seen as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.operators.audit import parent_report
from lexcorpus.operators.ingest import replace_relations, replace_versions, upsert
from lexcorpus.operators.publish import node_violations
from lexcorpus.operators.versions import overlaps, violations
from lexcorpus.sources import snapshot

TABLES = ["documents", "versions", "nodes", "relations"]
RELATIONS = "from_node string, to_node string, relation string"


def persist(folder: str, documents: DataFrame, versions: DataFrame, nodes: DataFrame, relations: DataFrame | None = None) -> dict[str, DataFrame]:
    """The next state of the corpus in ``folder``: documents and versions put over those of the same id, nodes of these versions replaced, relations that touch a replaced node dropped.

    Nothing changes, and ValueError says why, if a version breaks its rules, published versions
    of a document overlap, a node's parent isn't in its version or may not be, or a node lacks its locator or hash.
    """
    spark = documents.sparkSession
    relations = spark.createDataFrame([], RELATIONS) if relations is None else relations
    new = {"documents": documents, "versions": versions, "nodes": nodes, "relations": relations}
    old = snapshot.read_all(spark, folder, TABLES)
    if old is not None:
        gone = old["nodes"].join(nodes.select("document_version_id").distinct(), "document_version_id", "left_semi")
        new = {
            "documents": upsert(old["documents"], documents, "id", ["updated_at"]),
            "versions": upsert(old["versions"], versions, "id", ["version_number"]),
            "nodes": replace_versions(old["nodes"], nodes),
            "relations": replace_relations(old["relations"], gone, nodes).unionByName(relations).distinct(),
        }
    checks = {
        "version rules": lambda t: violations(t["versions"]),
        "overlap of published versions": lambda t: overlaps(t["versions"]),
        "node rules": lambda t: node_violations(t["nodes"]),
        "node hierarchy": lambda t: parent_report(t["nodes"]).where("orphan or invalid_parent or incompatible"),
        "unique locators": lambda t: t["nodes"].groupBy("document_version_id", "source_locator").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "nodes of known versions": lambda t: t["nodes"].join(t["versions"].select(F.col("id").alias("document_version_id")), "document_version_id", "left_anti"),
    }
    return snapshot.write_all(new, folder, checks)
