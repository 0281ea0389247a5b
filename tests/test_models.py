import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsieve.models import features, tagging, text
from tagsieve.operators import crossval
from tagsieve.sources import conll
from tagsieve.streaming import detect

LABELS = ["bad", "good"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"{'awful broken thing' if i % 2 else 'great lovely thing'} number {i % 7}", LABELS[i % 2 == 0]) for i in range(60)]
    return spark.createDataFrame([*rows, (60, None, "bad"), (61, "great lovely", None)], "id long, text string, noisy string")


@pytest.mark.parametrize("model", [text.max_ent, text.bigram_hash, text.forest, text.boosted_trees])
def test_text_models_learn(texts, model):
    predicted = {r.id: r for r in model(LABELS, width=1 << 10)(texts)(texts).collect()}
    assert len(predicted) == 62
    assert all(sum(r.probs) == pytest.approx(1) and len(r.probs) == 2 for r in predicted.values())
    assert sum(predicted[i].prediction == LABELS[i % 2 == 0] for i in range(60)) >= 58


class Words:
    """A tiny model of one's own: per class word counts, with dropout by a seed."""

    def fit(self, texts, targets, classes, on_epoch):
        self.counts, self.classes = {}, classes
        for epoch in range(3):
            for t, y in zip(texts, targets):
                for w in t.split():
                    self.counts.setdefault(w, np.ones(classes))[y] += 1
            on_epoch(epoch)

    def predict_proba(self, texts, dropout_seed=None):
        rng = None if dropout_seed is None else np.random.default_rng(dropout_seed)
        rows = []
        for t in texts:
            kept = [w for w in t.split() if rng is None or rng.random() > 0.5]
            p = np.prod([self.counts.get(w, np.ones(self.classes)) / self.counts.get(w, np.ones(self.classes)).sum() for w in kept], axis=0) if kept else np.ones(self.classes)
            rows.append(p / p.sum())
        return np.array(rows)


def test_own_models_are_fitted_asked_and_turned(texts):
    log = []
    fit = text.own_model(Words, LABELS, batch_size=7, on_epoch=lambda epoch, predict: log.append((epoch, predict(texts).where("prediction is not null").count())))
    assert fit.__name__ == "fit"
    predict = fit(texts)
    assert log == [(0, 62), (1, 62), (2, 62)]
    predicted = {r.id: r for r in predict(texts).collect()}
    assert all(predicted[i].prediction == LABELS[i % 2 == 0] for i in range(60))
    turned = crossval.repeat_inference(texts, predict, 5).collect()
    assert len(turned) == 62 * 5 and {r.t for r in turned} == set(range(5))
    assert len({tuple(r.probs) for r in turned if r.id == 3}) > 1
    folds = crossval.stratified_folds(texts, "id", "noisy", 3)
    held_out = {r.id: r.prediction for r in crossval.cross_validate(texts, folds, "id", text.own_model(Words, LABELS), 3).collect()}
    assert len(held_out) == 62 and sum(held_out[i] == LABELS[i % 2 == 0] for i in range(60)) >= 58


def test_first_word_model_sees_other_folds_only(spark):
    df = spark.createDataFrame([(i, f"word{i} x", LABELS[i % 2]) for i in range(20)], "id long, text string, noisy string")
    fit = text.first_word(LABELS)
    assert {tuple(r.probs) for r in fit(df)(df).collect()} == {(2 / 3, 1 / 3), (1 / 3, 2 / 3)}
    unseen = crossval.cross_validate(df, crossval.stratified_folds(df, "id", "noisy", 4), "id", fit, 4).collect()
    assert len(unseen) == 20 and {tuple(r.probs) for r in unseen} == {(0.5, 0.5)}


def test_taggers_turn(tokens):
    predict = tagging.crf([".", "D", "N", "V"])(tokens)
    turned = crossval.repeat_inference(tokens, predict, 4).collect()
    assert len(turned) == 4 * tokens.count() and all(sum(r.probs) == pytest.approx(1) for r in turned)
    assert len({tuple(r.probs) for r in turned if (r.sent_id, r.pos) == (0, 1)}) > 1
    again = {(r.sent_id, r.pos, r.t): r.probs for r in crossval.repeat_inference(tokens.repartition(3), predict, 4).collect()}
    assert all(again[r.sent_id, r.pos, r.t] == pytest.approx(r.probs) for r in turned)


def test_vectors_in_context(tokens):
    def make():
        return lambda sentences: [[[len(w), len(ws), k] for k, w in enumerate(ws)] for ws in sentences]

    rows = features.embed_in_context(tokens, make).join(tokens, ["sent_id", "pos"]).collect()
    assert len(rows) == tokens.count() and all(list(r.vec) == [len(r.token), 4, r.pos] for r in rows)


def test_missing_label_has_probability_zero(texts):
    predicted = text.max_ent([*LABELS, "never"], width=1 << 8)(texts)(texts).first()
    assert len(predicted.probs) == 3


def test_dummy_is_deterministic(texts):
    runs = [{r.id: r.prediction for r in text.dummy(LABELS)(texts)(texts.repartition(n)).collect()} for n in (1, 4)]
    assert runs[0] == runs[1] and set(runs[0].values()) == set(LABELS)


def test_batch_adapter(texts):
    def make():
        import numpy as np

        return lambda batch: np.array([[1.0, 0.0] if "awful" in t else [0.0, 1.0] for t in batch])

    predicted = {r.id: r.prediction for r in text.batch_model(make, LABELS)(texts).collect()}
    assert predicted[1] == "bad" and predicted[0] == "good" and len(predicted) == 62


@pytest.fixture(scope="module")
def tokens(spark):
    sentences = [("the cat sat .", "D N V ."), ("A dog ran !", "D N V ."), ("the dog sat .", "D N V ."), ("a cat ran .", "D N V .")] * 6
    rows = [(s, p, w, y) for s, (ws, ys) in enumerate(sentences) for p, (w, y) in enumerate(zip(ws.split(), ys.split()))]
    return spark.createDataFrame(rows, "sent_id long, pos int, token string, noisy string")


@pytest.mark.parametrize("model", [tagging.max_ent, tagging.crf])
def test_taggers_learn(tokens, model):
    names = [".", "D", "N", "V"]
    predicted = model(names)(tokens)(tokens)
    joined = predicted.join(tokens, ["sent_id", "pos"])
    assert predicted.count() == tokens.count()
    assert joined.where("prediction <> noisy").count() == 0
    assert all(sum(r.probs) == pytest.approx(1) for r in predicted.limit(9).collect())


def test_tagger_folds_cover_every_token(tokens):
    folds = crossval.plain_folds(tokens, "sent_id", 3)
    assert crossval.cross_validate(tokens, folds, "sent_id", tagging.dummy(["D", "N"]), 3).count() == tokens.count()


def test_chain_marginals_equal_enumeration():
    import itertools

    import numpy as np

    chain = tagging.LinearChain(3, 16)
    rng = np.random.default_rng(0)
    chain.emit, chain.move = rng.normal(size=(16, 3)), rng.normal(size=(3, 3))
    sentence = [np.array([1, 4]), np.array([7]), np.array([2, 9, 11])]
    scores = [chain.emit[t].sum(axis=0) for t in sentence]
    total, single = 0.0, np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=3):
        p = np.exp(sum(s[y] for s, y in zip(scores, path)) + chain.move[path[0], path[1]] + chain.move[path[1], path[2]])
        total += p
        for t, y in enumerate(path):
            single[t, y] += p
    assert np.allclose(chain.marginals(sentence)[0], single / total)


def test_token_features(spark):
    rows = [(0, "The"), (1, "iPhone-X"), (2, "@me"), (3, "42"), (4, "!"), (5, None)]
    found = features.token_features(spark.createDataFrame([(1, p, w) for p, w in rows], "sent_id long, pos int, token string")).orderBy("pos").collect()
    first, second = found[0].own, found[1].own
    assert first.is_title and first.is_first and first.next_word == "iphone-x" and first.suffix_2 == "he"
    assert second.capitals_inside and second.has_hyphen and not second.is_title and second.previous_word == "the"
    assert found[2].own.is_mention and found[3].own.is_digit and found[4].own.is_punctuation
    assert found[0].before is None and found[4].after.word is None and found[5].own.is_last


def test_tf_idf(spark):
    df = spark.createDataFrame([(1, "apple apple pear the"), (2, "apple plum"), (3, "the fig"), (4, None), (5, "kiwi")], "id long, text string")
    rows = features.tf_idf(df, "id", "text", ["the"]).collect()
    norms = {}
    for r in rows:
        norms[r.id] = norms.get(r.id, 0) + r.weight**2
    assert all(n == pytest.approx(1) for n in norms.values()) and set(norms) == {1, 2, 3, 5}
    first = {r.term: r.weight for r in rows if r.id == 1}
    assert set(first) == {"apple", "pear"} and first["apple"] > first["pear"]


def test_conll_round_trip(spark, tmp_path):
    (tmp_path / "a.conll").write_text("I\tA\tB\nam\tB\tB\n \t \nyou\tA\tA\n\n\n")
    (tmp_path / "b.conll").write_text("")
    read = conll.read_conll(spark, str(tmp_path / "*.conll"))
    rows = [(r.sent_no, r.pos, r.token, r.gold, r.noisy) for r in read.orderBy("sent_no", "pos").collect()]
    assert rows == [(0, 0, "I", "A", "B"), (0, 1, "am", "B", "B"), (1, 0, "you", "A", "A")]
    conll.write_conll(conll.with_sentence_ids(read), str(tmp_path / "out"))
    back = conll.read_conll(spark, str(tmp_path / "out" / "*.txt"))
    assert sorted((r.pos, r.token, r.gold, r.noisy) for r in back.collect()) == sorted(r[1:] for r in rows)


def test_streams_flag_each_delivery_once(spark, tmp_path):
    rows = [(1, 0, "2024-01-01 10:00:00", "a"), (1, 0, "2024-01-01 10:00:00", "a"), (2, 0, "2024-01-02 11:00:00", "b")]
    preds = spark.createDataFrame(rows, "id long, model int, run_at string, prediction string").withColumn("run_at", F.to_timestamp("run_at"))
    preds.coalesce(1).write.parquet(str(tmp_path / "in"))
    instances = spark.createDataFrame([(1, "a"), (2, "a")], "id long, noisy string")
    stream = spark.readStream.schema(preds.schema).parquet(str(tmp_path / "in"))
    query = detect.retag_stream(stream, instances).writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.id, r.flag) for r in spark.table("flags").collect()) == [(1, False), (2, True)]
    rates = detect.disagreement_rates(spark.table("flags")).collect()
    assert sorted((r.n, r.flagged) for r in rates) == [(1, 0), (1, 1)]


def test_dropout_model_learns_and_varies_by_turn(texts):
    predict = text.dropout_softmax(LABELS, width=1 << 12)(texts)
    predicted = {r.id: r for r in predict(texts).collect()}
    assert len(predicted) == 62 and sum(predicted[i].prediction == LABELS[i % 2 == 0] for i in range(60)) >= 58
    turns = [sorted((r.id, r.t, tuple(r.probs)) for r in crossval.repeat_inference(df, predict, 3).collect()) for df in (texts, texts.repartition(5))]
    assert turns[0] == turns[1] and len(turns[0]) == 186
    assert len({p for i, _, p in turns[0] if i == 3}) > 1


def test_tagger_and_embedding_adapters(tokens):
    def tagger():
        return lambda sentences: [[[1.0, 0.0] if w == "cat" else [0.0, 1.0] for w in words] for words in sentences]

    tagged = tagging.batch_tagger(tagger, ["CAT", "ELSE"])(tokens).join(tokens, ["sent_id", "pos"])
    assert tagged.count() == tokens.count() and tagged.where("(token = 'cat') <> (prediction = 'CAT')").count() == 0

    def embedder():
        import numpy as np

        return lambda words: np.array([[len(w), 1] for w in words], np.float32)

    vecs = features.embed(tokens, ["sent_id", "pos"], "token", embedder).join(tokens, ["sent_id", "pos"])
    assert vecs.count() == tokens.count() and vecs.where("vec[0] <> length(token)").count() == 0


def test_calibration_callback(texts, spark):
    from tagsieve.operators import metrics

    rows = texts.where("id < 60").select("id", "text", "noisy")
    truth = rows.select("id", F.when(F.col("noisy") == "good", 1).otherwise(0).alias("idx"))
    callback = metrics.CalibrationCallback(truth, ["id"])
    folds = crossval.stratified_folds(rows, "id", "noisy", 2)
    found = crossval.cross_validate(rows, folds, "id", text.dummy(LABELS), 2, (callback,))
    assert found.count() == 60 and "calibrated" in found.columns
    assert [e[0] for e in callback.errors] == [0, 1] and all(after <= before + 0.1 for _, before, after in callback.errors)


def test_iterative_fits_have_no_more_tasks_than_run_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(text, "ROWS_PER_TASK", 10)
    rows = spark.range(0, 1000, 1, 20)
    assert text.in_few_tasks(rows).rdd.getNumPartitions() == 20
    assert text.in_few_tasks(rows, at_a_time=True).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 20
    monkeypatch.setattr(text, "MAX_ROWS_PER_TASK", 100)
    assert text.in_few_tasks(rows, at_a_time=True).rdd.getNumPartitions() == 10
    assert text.in_few_tasks(rows.limit(7), at_a_time=True).rdd.getNumPartitions() == 1


def test_fits_at_a_time_fit_the_driver(texts):
    from threading import Lock

    going, most, lock = [0], [0], Lock()

    def fit(train):
        with lock:
            going[0] += 1
            most[0] = max(most[0], going[0])
        train.count()
        with lock:
            going[0] -= 1
        return lambda rows: rows.select("id")

    fit.driver_bytes = 1 << 50
    folds = crossval.stratified_folds(texts, "id", "noisy", 4)
    assert crossval.cross_validate(texts, folds, "id", fit, 4).count() == 62
    assert most[0] == 1
    assert text.bigram_hash(["a", "b", "c"]).driver_bytes == 25 * 8 * 3 * 200_000


def test_labels_go_with_the_features_of_their_tokens(spark, monkeypatch):
    seen = []

    def caught(rows, at_a_time):
        seen.append(rows)
        return rows

    monkeypatch.setattr(tagging, "in_few_tasks", caught)
    rows = [(s, p, w, y) for s in range(4) for p, (w, y) in enumerate([("the", "D"), ("Oak", None), ("falls", "V"), ("?", "other")])]
    tokens = spark.createDataFrame(rows, "sent_id long, pos int, token string, noisy string")
    assert tagging.max_ent(["D", "V"], iterations=2)(tokens)(tokens).count() == 16
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    whole = {(r.pos, r.vector) for r in _vectors(tokens).collect()}
    assert {(r.y, r.vector) for r in seen[0].collect()} == {(p / 2, v) for p, v in whole if p in (0, 2)}
    assert seen[0].count() == 8


def _vectors(tokens):
    from pyspark.ml.feature import HashingTF

    hashing = HashingTF(inputCol="features", outputCol="vector", numFeatures=1 << 14, binary=True)
    return hashing.transform(features.feature_strings(features.token_features(tokens)))
