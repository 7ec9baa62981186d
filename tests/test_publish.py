from datetime import datetime as D

from lexcorpus.operators import publish as P
from pyspark.sql import functions as F

STATE = "id string, document_id string, version_number int, effective_from timestamp_ntz, effective_to timestamp_ntz, content_hash string, parser_id string, status string, decision string"
NEW = "document_id string, content_hash string, parser_id string, effective_from timestamp_ntz"


def state(df, doc):
    return sorted((r.version_number, r.status, r.effective_from, r.effective_to, r.decision) for r in df.where(F.col("document_id") == doc).collect())


def test_publish(spark):
    v = spark.createDataFrame([(f"{d}1", d, 1, D(2020, 1, 1), end, "h", "p1", "PUBLISHED", "x") for d, end in (("same", None), ("canon", None), ("update", None), ("ended", D(2021, 1, 1)), ("left", None))], STATE)
    new = spark.createDataFrame([("same", "h", "p1", D(2022, 1, 1)), ("canon", "h", "p2", D(2022, 1, 1)), ("update", "g", "p1", D(2022, 1, 1)), ("update", "g", "p1", D(2022, 1, 1)), ("ended", "g", "p1", None), ("first", "g", "p1", D(2022, 1, 1))], NEW)
    got = P.publish(v, new, "2025-01-01")
    start = D(2020, 1, 1)
    assert state(got, "same") == [(1, "PUBLISHED", start, None, "kept")] == state(got, "left")
    assert state(got, "canon") == [(1, "SUPERSEDED", start, None, "kept"), (2, "PUBLISHED", None, None, "canonicalization")]
    assert state(got, "update") == [(1, "SUPERSEDED", start, D(2025, 1, 1), "kept"), (2, "PUBLISHED", D(2022, 1, 1), None, "source_update")]
    assert state(got, "ended")[0] == (1, "SUPERSEDED", start, D(2021, 1, 1), "kept")
    assert state(got, "first") == [(1, "PUBLISHED", D(2022, 1, 1), None, "new_document")]
    again = P.publish(got, new, "2026-01-01")
    assert again.count() == got.count() and again.where("decision <> 'kept'").count() == 0
    assert P.publish(v.limit(0), new.limit(0), "2025-01-01").count() == 0


def test_tree_order_and_cascade(spark):
    rows = [("r", None, D(2020, 1, 1)), ("b", "r", D(2020, 1, 2)), ("a", "r", D(2020, 1, 3)), ("x", "b", D(2020, 1, 4)), ("loop", "loop", D(2020, 1, 1))]
    nodes = spark.createDataFrame([(i, p, t, t, "v", "l", "h") for i, p, t in rows], "id string, parent_id string, created_at timestamp_ntz, updated_at timestamp_ntz, document_version_id string, source_locator string, content_hash string")
    assert [r.node_id for r in P.preorder(nodes).orderBy("place").collect()] == ["r", "b", "x", "a"]
    assert sorted(r.node_id for r in P.cascade(nodes, nodes.where("id in ('b', 'loop')")).collect()) == ["b", "loop", "x"]
    assert P.node_violations(nodes).count() == 0 and P.node_violations(nodes.unionByName(nodes.where("id = 'a'"))).collect() == [("a", "delivered_twice")]


def test_migration(spark):
    docs = spark.createDataFrame([("d1", " A1 ", "тушаал"), ("d2", "gone", "x"), ("d2", "gone", "x"), ("d3", None, "x"), ("d4", "a1", "x")], "id string, archive_id string, title string")
    articles = spark.createDataFrame([("p", "d1", "1", 0), ("q", "d1", "1", 1), ("z", "d2", "1", 0)], "id string, document_id string, article_number string, ord int")
    archives = spark.createDataFrame([("a1",), ("a1",)], "id string")
    got = {r.document_id: (r.outcome, r.n_nodes) for r in P.migrate(docs, articles, archives, F.lit("LAW")).collect()}
    assert got == {"d1": ("migrated", 3), "d2": ("no_matching_archive", 0), "d3": ("no_matching_archive", 0), "d4": ("migrated", 1)}
