import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsieve.models import boosting, text
from tagsieve.operators import crossval

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def texts(spark):
    rng, rows = random.Random(1), [(-1, None, "a"), (-2, "w1 w2", None), (-3, "", "b"), (-4, "w3", "other")]
    for i in range(900):
        y = rng.choice(LABELS)
        own = [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 12))] + ["zz" + y] * rng.randint(0, 3) + ["q"] * rng.randrange(60)
        rows.append((i, " ".join(own), y))
    return spark.createDataFrame(rows, "id long, text string, noisy string").coalesce(2).cache()


def test_folds_are_fitted_together_in_a_pass_a_level(spark, texts):
    folds = crossval.stratified_folds(texts, "id", "noisy", 3)
    fit = text.boosted_trees(LABELS, trees=5, width=256)
    spark.sparkContext.setJobGroup("boosted", "")
    found = {r.id: r.probs for r in crossval.cross_validate(texts, folds, "id", fit, 3).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 904 and jobs <= 5 * 4 + 30
    assigned = texts.join(folds, "id").cache()
    for f in range(3):
        own = fit(assigned.where(F.col("fold") != f).repartition(5))(assigned.where(F.col("fold") == f)).collect()
        assert own and all(found[r.id] == r.probs for r in own)


def test_boosted_trees_equal_sparks(spark, texts):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    vectors = HashingTF(inputCol="words", outputCol="features", numFeatures=256).transform(texts.withColumn("words", words)).cache()
    train = vectors.where(F.col("noisy").isin(LABELS) & (F.col("id") % 3 != 0))
    raw = {}
    for y in LABELS:
        model = GBTClassifier(maxIter=4, maxDepth=4, seed=42).fit(train.select("features", (F.col("noisy") == y).cast("double").alias("label")))
        for r in model.transform(vectors).select("id", vector_to_array("probability")[1].alias("p")).collect():
            raw.setdefault(r.id, []).append(r.p)
    found = text.boosted_trees(LABELS, trees=4, width=256)(train.select("id", "text", "noisy"))(texts).collect()
    assert len(found) == 904
    other = [r.id for r in found if r.probs != pytest.approx([p / sum(raw[r.id]) for p in raw[r.id]], abs=1e-9)]
    assert len(other) <= 4 and all(i % 3 == 0 for i in other)  # of splits that part the training rows alike, Spark's rounding picks one


def test_models_grown_in_groups_are_the_same(texts, monkeypatch):
    fit = text.boosted_trees([*LABELS, "never"], trees=2, width=256)
    whole = {r.id: r.probs for r in fit(texts)(texts).collect()}
    monkeypatch.setattr(boosting, "PASS_BYTES", 1)
    assert {r.id: r.probs for r in fit(texts)(texts).collect()} == whole
    assert all(p[3] == 0 and sum(p) == pytest.approx(1) for p in whole.values())


def test_trees_without_words_or_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "!", "b")]
    found = text.boosted_trees(LABELS, trees=3)(spark.createDataFrame(rows, "id long, text string, noisy string"))
    p = {tuple(r.probs) for r in found(spark.createDataFrame([*rows, (4, "new words", None)], "id long, text string, noisy string")).collect()}
    assert len(p) == 1 and (only := p.pop())[0] > only[1] > only[2] == 0
    none = text.boosted_trees(LABELS)(spark.createDataFrame([], "id long, text string, noisy string"))
    assert [r.probs for r in none(spark.createDataFrame(rows[:1], "id long, text string, noisy string")).collect()] == [[1 / 3] * 3]


def test_scores_that_a_worker_lacks_are_added_up_again(monkeypatch):
    rng = np.random.default_rng(0)
    codes = np.concatenate([np.sort(rng.choice(6, 3, replace=False)) for _ in range(50)]).astype(np.int32)
    block = boosting.Block("x", -1, rng.integers(0, 2, 50).astype(np.int32).tobytes(), np.arange(0, 151, 3, dtype=np.int32).tobytes(), codes.tobytes(), 6)
    trees = [(low := rng.integers(0, 5, (2, 15)), low + 1, rng.normal(size=(2, 16))) for _ in range(3)]
    step = lambda n: boosting.Pass("run", 6, np.array([0, 0]), np.array([0, 1]), trees[:n], None, None, 0, None)
    kept = [step(n).scores(block, np.arange(2)).copy() for n in (1, 2, 3, 2)]
    monkeypatch.setattr(boosting, "KEPT_BYTES", 0)
    assert all(np.array_equal(a, step(n).scores(block, np.arange(2))) for a, n in zip(kept, (1, 2, 3, 2))) and not boosting._KEPT


def test_bins_of_many_values_have_about_as_many_rows():
    assert boosting.cuts(np.arange(32), np.ones(32)) == list(range(1, 32))
    at = boosting.cuts(np.arange(320), np.ones(320))
    assert len(at) == 31 and set(np.diff([0, *at, 320])) == {10}
