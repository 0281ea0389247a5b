"""The registered queries run their operators whole."""

import inspect
import os

import pytest

import __spark_entry__
from tagsieve.operators import crossval, dynamics, vectors

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name, epochs", [("datamap_trained", 24), ("curriculum_spotter", 24), ("leitner_spotter", 48)])
def test_training_queries_run_all_epochs(spark, monkeypatch, name, epochs):
    steps = []
    if name == "leitner_spotter":  # its epochs share passes, so the moves of the weights are counted
        monkeypatch.setattr(dynamics.SoftmaxTraining, "moved", lambda self, weights, gradient, rows: (steps.append(1), weights)[1])
    monkeypatch.setattr(dynamics.SoftmaxTraining, "step", lambda self, weights, chosen: (steps.append(1), weights)[1])
    monkeypatch.setattr(dynamics.SoftmaxTraining, "final", lambda self, run, schema: spark.createDataFrame([], schema))
    __spark_entry__.queries()[name](spark, SMALL)
    assert len(steps) == epochs


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_projection_query_has_all_models(spark, monkeypatch):
    votes, whole = [], vectors.projection_ensemble

    def kept(*args, **settings):
        flags, own = whole(*args, **settings)
        votes.append(own)
        return flags, own

    monkeypatch.setattr(vectors, "projection_ensemble", kept)
    __spark_entry__.queries()["projection_ensemble"](spark, SMALL)
    assert votes[0].select("model").distinct().count() == 17


SETTINGS = {
    "oof_max_ent_text": lambda own: own["estimator"].getMaxIter() == 100,
    "oof_bigram_hash_text": lambda own: own["estimator"].getMaxIter() == 50 and own["stages"][-1].getNumFeatures() == 200_000,
    "oof_forest_text": lambda own: own["estimator"].getNumTrees() == 30,
    "oof_boosted_trees_text": lambda own: own["trees"] == 20,
    "oof_dropout_text": lambda own: own["epochs"] == 3 and own["max_train_rows"] == 50_000,
    "oof_max_ent_tags": lambda own: own["iterations"] == 50,
    "oof_crf_tags": lambda own: own["epochs"] == 3 and own["max_train_sentences"] == 5_000,
}


class Caught(Exception):
    pass


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", SETTINGS)
def test_fitted_models_have_their_defaults_and_ten_folds(spark, monkeypatch, name):
    def caught(df, folds, row_id, fit, k):
        raise Caught(k, inspect.getclosurevars(fit).nonlocals)

    monkeypatch.setattr(crossval, "cross_validate", caught)
    with pytest.raises(Caught) as found:
        __spark_entry__.queries()[name](spark, SMALL)
    folds, own = found.value.args
    assert folds == 10 and SETTINGS[name](own)
