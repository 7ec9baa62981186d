import random
from datetime import datetime as D

from pyspark.sql import functions as F

from lexcorpus.operators import versions as V
from lexcorpus.operators.scan import running

SCHEMA = "id string, document_id string, version_number int, effective_from timestamp_ntz, effective_to timestamp_ntz, content_hash string, parser_id string, status string, archive_record_id string"


def make(spark, rows):
    return spark.createDataFrame([(i, d, n, a, b, "h", "p", s, "r") for i, d, n, a, b, s in rows], SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_as_of_is_half_open_and_needs_both_bounds(spark):
    v = make(spark, [("v1", "d", 1, D(2020, 1, 1), D(2022, 1, 1), "SUPERSEDED"), ("v2", "d", 2, D(2022, 1, 1), D(2024, 1, 1), "PUBLISHED"), ("o", "e", 1, D(2020, 1, 1), None, "PUBLISHED"), ("n", "f", 1, None, None, "PUBLISHED"), ("w", "d", 3, D(2020, 1, 1), D(2024, 1, 1), "WITHDRAWN")])
    assert ids(V.as_of(v, "2021-06-01")) == ["v1"] and ids(V.as_of(v, "2022-01-01")) == ["v2"] and ids(V.as_of(v, "2024-01-01")) == []
    assert ids(V.as_of(v, "not a date")) == [] and ids(V.current(v)) == ["n", "o", "v2"]


def test_overlaps(spark):
    v = make(spark, [("a", "d", 1, D(2020, 1, 1), None, "PUBLISHED"), ("b", "d", 2, D(2021, 1, 1), None, "PUBLISHED"), ("c", "e", 1, D(2019, 1, 1), D(2020, 12, 31, 23, 59, 59), "PUBLISHED"), ("f", "e", 2, D(2021, 1, 1), None, "PUBLISHED"), ("g", "t", 1, D(2019, 1, 1), D(2020, 1, 1), "PUBLISHED"), ("h", "t", 2, D(2020, 1, 1), D(2021, 1, 1), "PUBLISHED"), ("i", "t", 3, D(2019, 1, 1), None, "DRAFT")])
    assert ids(V.overlaps(v)) == ["b", "h"] and ids(V.overlaps(v, closed=False)) == ["b"]


def test_succession_numbers_violations(spark):
    v = make(spark, [("a", "d", 1, D(2020, 1, 1), None, "SUPERSEDED"), ("b", "d", 2, D(2021, 1, 1), None, "PUBLISHED"), ("x", "d", 0, D(2022, 1, 1), D(2021, 1, 1), "DRAFT")])
    got = {r.id: (r.replaces_id, r.replaced_by_id, r.in_force_until) for r in V.succession(v).collect()}
    assert got == {"a": (None, "b", D(2021, 1, 1)), "b": ("a", None, None)}
    assert {r.id: r.violations for r in V.violations(v).collect()} == {"x": ["version_number", "reversed_bounds"]}
    docs = spark.createDataFrame([("d",), ("e",)], "id string")
    assert {r.document_id: r.next_version for r in V.next_numbers(docs, v).collect()} == {"d": 3, "e": 1}


def test_running_equals_a_plain_window_over_any_partitioning(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 2 else f"g{i % 5}", i, rng.choice([None, *range(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = running(df, ["g"], ["o"], before={"top": F.col("v")}, after={"low": F.col("v")})
    for r in got.collect():
        before = [v for g, o, v in rows if g == r.g and o < r.o and v is not None]
        after = [v for g, o, v in rows if g == r.g and o > r.o and v is not None]
        assert r.top == max(before, default=None) and r.low == min(after, default=None)
    assert running(df.limit(0), ["g"], ["o"], before={"top": F.col("v")}).count() == 0
