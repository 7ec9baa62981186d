from datetime import datetime as D

import lexcorpus.operators.references as R
from lexcorpus.operators.references import Reference, Target, orphan_counts, orphans


def setup(spark, parents, refs):
    t = Target("p", spark.createDataFrame(parents, "id string, at timestamp_ntz"), "id", "at")
    return [t], [Reference("c", spark.createDataFrame(refs, "key string, id string, fk string, at timestamp_ntz, target string, n int"), "id", "fk", "p", "at")]


def test_states_periods_and_key_forms(spark):
    parents = [("A1", D(2020, 1, 1)), ("A1", D(2019, 1, 1)), (" b2 ", D(2021, 5, 1)), (None, None), ("", D(2000, 1, 1))]
    refs = [("k", "r1", " a1", D(2019, 6, 1), "t", 1), ("k", "r2", "B2", D(2021, 4, 1), "t", 1), ("k", "r3", "zz", D(2021, 4, 1), "t", 1), ("k", "r3", "zz", D(2021, 4, 1), "t", 1), ("k", "r4", None, D(2021, 4, 1), "t", 1), ("k", "r5", " \t", D(2021, 4, 1), "t", 1), ("k", "r6", "b2", None, "t", 1), ("k", "r7", "zz", None, "t", 1)]
    got = orphans(*setup(spark, parents, refs))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [("c", "r2", "fk", "late", "2021-04"), ("c", "r3", "fk", "missing", "2021-04"), ("c", "r7", "fk", "missing", None)]
    assert sum(r.n_references for r in orphan_counts(got).collect()) == 3


def test_hot_keys_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT", 2)
    refs = [("k", f"r{i}", f"m{i % 3 if i < 90 else i}", D(2021, 1, 1), "t", 1) for i in range(100)]
    assert orphans(*setup(spark, [], refs)).count() == 100
    assert orphans(*setup(spark, [("m0", D(2020, 1, 1))], refs)).count() == 70
    assert orphans(*setup(spark, [("m0", D(2020, 1, 1))], [])).count() == 0
