import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_a_place():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p3_found", "p5_found", "flagship_oof_scores"} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_flagship(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and "margin" in rows.columns
