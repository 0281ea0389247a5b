import types

import pytest

from tagsieve.plans import runtime


def test_stored_tables_keep_their_rows_and_partitions(spark):
    df = spark.range(100).selectExpr("id", "cast(id % 3 as int) as part")
    kept = runtime.stored(df, "part")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert kept.where("part = 1").count() == 33
    assert runtime.stored(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    none = types.SimpleNamespace(isEmpty=lambda: True)
    context = types.SimpleNamespace(master="yarn", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none)))
    session = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda name, other: other))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(session)
