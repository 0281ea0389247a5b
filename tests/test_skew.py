from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tagsieve.operators import skew


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def keyed(spark):
    keys = ["hot"] * 60 + ["warm"] * 30 + [f"k{i}" for i in range(100)] + [None] * 10
    data = [(i, k, "ab"[i % 2], "extra") for i, k in enumerate(keys)]
    return spark.createDataFrame(data, "id long, key string, label string, n string")


def test_heavy_keys_are_exact_and_null_is_none(keyed):
    found = skew.heavy_keys(keyed, "key", 0.1)
    assert rows_of(found) == [("hot", 60, 200), ("warm", 30, 200)]
    assert found.columns == ["key", "n", "total"]


def test_threshold_counts_null_rows_in_the_total(spark):
    data = [("a",)] * 2 + [(None,)] * 98
    df = spark.createDataFrame(data, "key string")
    assert rows_of(skew.heavy_keys(df, "key", 0.02)) == [("a", 2, 100)]
    assert rows_of(skew.heavy_keys(df, "key", 0.03)) == []


def test_a_key_of_exactly_the_share_is_heavy(spark):
    for total, n in ((350, 7), (50, 1), (1_150, 23), (2_900, 58)):
        df = spark.range(total).select(F.when(F.col("id") < n, "at").otherwise(F.concat(F.lit("k"), F.col("id") % (total - n))).alias("key"))
        assert ("at", n, total) in rows_of(skew.heavy_keys(df, "key", 0.02))


def test_empty_and_null_tables_have_no_heavy_keys(spark):
    assert skew.heavy_keys(spark.createDataFrame([], "key string"), "key", 0.1).count() == 0
    assert skew.heavy_keys(spark.createDataFrame([(None,)], "key string"), "key", 0.1).count() == 0


def test_long_tail_does_not_hide_a_heavy_key(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 45 == 0, "heavy").otherwise(F.concat(F.lit("t"), "id")).alias("key"))
    assert [r.key for r in skew.heavy_keys(df, "key", 0.02).collect()] == ["heavy"]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [100_000, 0])
def test_skew_join_equals_a_plain_join(spark, keyed, how, limit):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4), ("absent", 5)], "key string, v int")
    left = keyed.select("id", "key")
    expected = left.join(right, "key", how)
    assert rows_of(skew.skew_join(left, right, "key", how, share=0.1, max_broadcast_rows=limit)) == rows_of(expected)


def test_skew_join_refuses_clashing_columns(keyed, spark):
    with pytest.raises(ValueError):
        skew.skew_join(keyed, spark.createDataFrame([("hot", "x")], "key string, label string"), "key")
    with pytest.raises(ValueError):
        skew.skew_join(keyed, keyed.select("key"), "key", "outer")


def test_majority_by_key_covers_every_row_and_breaks_ties_by_first(keyed):
    found = {r.id: r for r in skew.majority_by_key(keyed, "key", "label", "id", 0.1).collect()}
    assert len(found) == 200
    assert found[0].majority == "a" and found[0].n == 60
    assert found[199].majority is None and found[199].n is None


def test_majority_with_null_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "k", None), (2, "k", "x"), (3, "only", None)], "id long, key string, label string")
    found = {r.id: (r.majority, r.n) for r in skew.majority_by_key(df, "key", "label", "id", 0.5).collect()}
    assert found == {1: ("x", 1), 2: ("x", 1), 3: (None, None)}
    assert skew.majority_by_key(df.limit(0), "key", "label", "id", 0.5).count() == 0


@pytest.mark.parametrize("share", [0.001, 0.05, 1.0])
def test_results_by_key_are_whole(keyed, share):
    rows = keyed.drop("n")
    results = skew.results_by_key(rows, "key", lambda part: part.groupBy("key").agg(F.count("*").alias("n")), share).collect()
    expected = Counter(r.key for r in rows.collect() if r.key is not None)
    assert {r.key: r.n for r in results} == expected and len(results) == len(expected)


def test_empty_string_is_a_key_of_its_own(spark):
    df = spark.createDataFrame([("",), ("",), ("a",), (None,)], "key string")
    assert ("", 2, 4) in rows_of(skew.heavy_keys(df, "key", 0.5))


def test_very_long_keys(spark):
    long = "x" * 200_000
    df = spark.createDataFrame([(long,)] * 3 + [("b",)] * 3, "key string")
    assert {r.n for r in skew.heavy_keys(df, "key", 0.4).collect()} == {3}


def test_token_query_joins_the_heavy_keys_apart(spark, tmp_path):
    words = ["The"] * 90 + ["the"] * 30 + ["cat", "dog", "Cat", None]
    rows = [(k // 10, k % 10, w, "ab"[k % 3 == 0] if k % 7 else None) for k, w in enumerate(words)]
    spark.createDataFrame(rows, "sent_id long, pos int, token string, noisy string").write.parquet(str(tmp_path / "tokens.parquet"))
    found = __spark_entry__.queries()["p3_token_majority"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=broadcast" in plan
    labels = Counter((w.lower(), y) for _, _, w, y in rows if w and y)
    known = {w: max((y for v, y in labels if v == w), key=lambda y: labels[w, y]) for w, _ in labels}
    want = []
    for s, p, w, y in rows:
        form = w and w.lower()
        best = known.get(form)
        n = sum(c for (v, _), c in labels.items() if v == form) or None
        want.append((s * 100_000 + p, form, best, n, None if y is None or best is None else y != best))
    assert rows_of(found) == sorted(want, key=repr)
