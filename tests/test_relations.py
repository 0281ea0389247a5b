import pytest

from tagsieve.plans import relations
from tagsieve.registry import DETECTORS, Kind


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "t", "a", 0)], "id int, text string, noisy string, more int")
    assert relations.check(df, "instances") is df
    with pytest.raises(ValueError):
        relations.check(df.drop("noisy"), "instances")
    with pytest.raises(ValueError):
        relations.check(df.withColumn("text", df.id), "instances")


def test_facts(spark):
    df = spark.createDataFrame([(3, "b", "b"), (1, "a", "b"), (2, None, "a")], "id long, noisy string, gold string")
    assert tuple(relations.summary(df).first()) == (3, 2)
    assert [tuple(r) for r in relations.label_encoder(df).orderBy("idx").collect()] == [(0, "a"), (1, "b")]
    assert {r.id: r.is_error for r in relations.error_flags(df).collect()} == {1: True, 2: None, 3: False}
    assert sorted(r.noisy for r in relations.tag_set(df).collect()) == ["a", "b"]
    assert [r.id for r in relations.subset(df, 2).collect()] == [1, 2]
    with pytest.raises(IndexError):
        relations.subset(df, 4)


def test_registry():
    assert len(DETECTORS) == 25
    assert DETECTORS["dropout_uncertainty"].needs_multiple_probabilities
    assert DETECTORS["retag"].supports_correction and not DETECTORS["retag"].uses_probabilities
    assert DETECTORS["borda_count"].kind is Kind.SCORER
