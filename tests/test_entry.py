import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert {"p2_found", "p4_found", "p5_found"} <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["node_id", "path", "depth", "root_id"] and df.count() > 0
