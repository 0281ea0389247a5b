import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsieve import registry
from tagsieve.operators import crossval, dynamics, ensemble, labels, metrics, noise, probability, ranking, sequences, spans, vectors
from tagsieve.plans import detectors


def by_id(df, value="score", key="id"):
    return {r[key]: r[value] for r in df.collect()}


def token_rows(sentences, *labels):
    return [(s, p, *row) for s, parts in enumerate(zip(sentences, *labels)) for p, row in enumerate(zip(*parts))]


@pytest.fixture
def forms(spark):
    rows = [(1, "delta", "SEA"), (2, "oak", "TREE"), (3, "delta", "RIVER"), (4, "delta", "RIVER"), (5, "oak", "TREE"), (6, "larch", "TREE")]
    return spark.createDataFrame(rows, "id long, form string, noisy string")


def test_majority_label(spark):
    df = spark.createDataFrame([(1, "spam"), (2, "ham"), (3, None), (4, "ham"), (5, "eggs"), (6, "spam"), (7, "ham")], "id long, noisy string")
    found = labels.majority_label(df, "id", "noisy")
    assert by_id(found, "flag") == {1: True, 2: False, 3: None, 4: False, 5: True, 6: True, 7: False}
    assert set(by_id(found, "corrected").values()) == {"ham"}


def test_majority_per_form(forms):
    assert by_id(labels.majority_per_form(forms, "id", "form", "noisy"), "flag") == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, "f", "b"), (2, "f", "a"), (3, "f", "a"), (4, "f", "b")], "id long, form string, noisy string")
    for parts in (1, 5):
        assert set(by_id(labels.majority_per_form(df.repartition(parts), "id", "form", "noisy"), "corrected").values()) == {"b"}


def test_label_entropy_and_discrepancy(spark):
    rows = [(i, "f", y) for i, y in enumerate("aaaabbc")] + [(7, "g", "a"), (8, "h", None), (9, None, "a")]
    df = spark.createDataFrame(rows, "id long, form string, noisy string")
    bits = -sum(p * math.log2(p) for p in (4 / 7, 2 / 7, 1 / 7))
    entropy = by_id(labels.label_entropy(df, "id", "form", "noisy"))
    assert bits > 1 and entropy[0] == pytest.approx(1) and entropy[4] == pytest.approx(0) and entropy[8] is None
    intended = by_id(labels.label_entropy(df, "id", "form", "noisy", majority_zero=True))
    assert intended[0] == 0 and intended[6] == pytest.approx(1)
    discrepancy = by_id(labels.weighted_discrepancy(df, "id", "form", "noisy"))
    assert discrepancy[0] == 0 and discrepancy[5] == pytest.approx(1) and discrepancy[7] == 0


def test_constant_scores(spark):
    df = spark.createDataFrame([(1, "f", "a"), (2, "g", "a")], "id long, form string, noisy string")
    assert by_id(labels.label_entropy(df, "id", "form", "noisy")) == {1: 1.0, 2: 1.0}
    assert by_id(labels.weighted_discrepancy(df, "id", "form", "noisy")) == {1: 0.0, 2: 0.0}


PROBS = [(1, [0.125, 0.125, 0.75]), (2, [0.5, 0.25, 0.25]), (3, [0.0, 1.0, 0.0])]


@pytest.fixture
def probs(spark):
    return spark.createDataFrame(PROBS, "id long, probs array<double>")


@pytest.fixture
def classes(spark):
    return spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "idx int, label string")


def test_entropy_margin_and_uncertainty(spark, probs, classes):
    found = by_id(probability.classification_entropy(probs))
    assert found == pytest.approx({i: -sum(x * math.log(x) for x in row if x) for i, row in PROBS})
    assert found[2] == pytest.approx(1.5 * math.log(2)) and found[3] == 0
    assert by_id(probability.prediction_margin(probs)) == pytest.approx({1: 0.375, 2: 0.75, 3: 0.0})
    labelled = probs.join(spark.createDataFrame([(1, "B"), (2, "C"), (3, "?")], "id long, noisy string"), "id")
    assert by_id(probability.classification_uncertainty(labelled, classes)) == pytest.approx({1: 0.875, 2: 0.75, 3: None})


def test_entropy_rescales(spark):
    df = spark.createDataFrame([(1, [2.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id long, probs array<double>")
    assert by_id(probability.classification_entropy(df)) == pytest.approx({1: math.log(2), 2: None, 3: None, 4: None})


def test_dropout(spark):
    rep = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.0]), (2, 1, [1.0, 0.0])], "id long, t int, probs array<double>")
    assert by_id(probability.dropout_uncertainty(rep)) == pytest.approx({1: math.log(2), 2: 0})
    assert by_id(probability.dropout_uncertainty(rep, formulation="original")) == pytest.approx({1: 0.5, 2: 0})
    assert by_id(probability.dropout_uncertainty(rep, formulation="variance")) == pytest.approx({1: 0.25, 2: 0})


def test_confident_learning_finds_swapped_labels(spark, classes):
    rng = random.Random(0)
    rows, wrong = [], set()
    for i in range(300):
        true = rng.randrange(3)
        p = [0.05 + rng.random() * 0.05] * 3
        p[true] = 1 - sum(p) + p[true]
        label = true
        if i % 10 == 0:
            label, _ = (true + 1) % 3, wrong.add(i)
        rows.append((i, "ABC"[label], p))
    df = spark.createDataFrame([*rows, (900, None, [1.0, 0.0, 0.0]), (901, "A", None)], "id long, noisy string, probs array<double>")
    flags = by_id(probability.confident_learning(df, classes), "flag")
    assert {i for i, f in flags.items() if f} == wrong
    assert flags[900] is None and flags[901] is None


def test_ensemble_vote(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([(i, rng.choice("XYZ")) for i in range(40)], "id long, noisy string")
    votes = [(i, m, rng.choice("XYZ")) for i in range(40) for m in range(4)]
    expected = {}
    for i in range(40):
        own = [p for j, _, p in votes if j == i]
        expected[i] = min(set(own), key=lambda p: (-own.count(p), p))
    found = ensemble.majority_voting_ensemble(df, spark.createDataFrame(votes, "id long, model int, prediction string"))
    assert by_id(found, "corrected") == expected
    assert by_id(found, "flag") == {r.id: r.noisy != expected[r.id] for r in df.collect()}


def test_borda(spark):
    rng = random.Random(12)
    scorers = [[rng.randrange(5) / 4 for _ in range(9)] for _ in range(3)]
    rows = [(str(s), i, x) for s, xs in enumerate(scorers) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "scorer string, id long, score double").repartition(6)
    places = [{i: n for n, (_, i) in enumerate(sorted(zip(xs, range(9))), 1)} for xs in scorers]
    assert by_id(ensemble.borda_count(df)) == {i: sum(p[i] for p in places) for i in range(9)}


def test_global_rank_equals_a_sort(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {r.id: r.place for r in ranking.global_rank(df, [F.col("v"), F.col("id")], "place", ["g"]).collect()}
    for g in ("x", "y", None):
        order = sorted((v, i) for i, h, v in rows if h == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    assert ranking.global_rank(df.limit(0), [F.col("v")]).count() == 0


def test_dawid_skene_trusts_the_better_workers(spark):
    rng = random.Random(1)
    truth = [rng.randrange(3) for _ in range(400)]
    skill = [0.95, 0.9, 0.34, 0.34, 0.34]
    votes = [(i, w, t if rng.random() < s else rng.randrange(3)) for i, t in enumerate(truth) for w, s in enumerate(skill)]
    df = spark.createDataFrame([(i, "abc"[t]) for i, t in enumerate(truth)], "id long, noisy string")
    votes = spark.createDataFrame(votes, "id long, worker int, label int")
    found = by_id(ensemble.label_aggregation(df, votes, list("abc"), 5, iterations=30), "corrected")
    assert sum(found[i] == "abc"[t] for i, t in enumerate(truth)) > 370
    _, patterns = ensemble.answer_patterns(votes, "id", 5)
    local, spread = (ensemble.dawid_skene(patterns, 5, 3, 5, max_local=m) for m in (1_000, 0))
    assert np.allclose(local[1], spread[1])


def test_item_response_flags_what_good_models_miss(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "a") for i in range(200)], "id long, noisy string")
    preds = []
    for i in range(200):
        wrong = i % 20 == 0
        preds += [(i, m, "a" if (rng.random() < good) != wrong else "b") for m, good in enumerate((0.97, 0.97, 0.9, 0.6, 0.5))]
    flags = by_id(ensemble.item_response_flags(df, spark.createDataFrame(preds, "id long, model int, prediction string"), 5), "flag")
    hits = [i for i in range(0, 200, 20) if flags[i]]
    assert len(hits) >= 7 and sum(flags.values()) < 60
    votes = spark.createDataFrame(preds, "id long, model int, prediction string")
    assert by_id(ensemble.item_response_flags(df, votes, 5, rounds=4, max_local=0), "flag") == by_id(ensemble.item_response_flags(df, votes, 5, rounds=4), "flag")
    assert ensemble.item_response_flags(df, votes.limit(0), 5).count() == 0


def cloud(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 5)) + 4 * np.eye(3, 5)[y]
    label = np.where(np.arange(n) % 15 == 0, (y + 1) % 3, y)
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (n, None, 1), (n + 1, [0.0] * 5, None)], "vec_id long, embedding array<float>, label int")


def test_neighbours_equal_brute_force_in_any_blocks(spark):
    rows, df = cloud(spark)
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    d = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    expected = {i: [j for _, j in sorted(zip(d[i], range(len(rows))))[:4]] for i in range(len(rows))}
    for size in (vectors.BLOCK_BYTES, 40 * 30):
        near = vectors.nearest_neighbours(df, "vec_id", "embedding", "label", 4, block_bytes=size)
        assert {r.vec_id: [x.id for x in r.near] for r in near.collect()} == expected


def test_vector_detectors_find_swapped_labels(spark):
    rows, df = cloud(spark)
    swapped = {i for i, _, _ in rows if i % 15 == 0}
    close = df.withColumn("embedding", F.transform("embedding", lambda x: (x / 5).cast("float")))  # a row's own weight is 1
    flagged = {i for i, f in by_id(vectors.knn_flagger(close, k=9), "flag", "vec_id").items() if f}
    assert len(flagged & swapped) >= 7 and len(flagged - swapped) <= 6
    for metric in ("euclidean", "cosine", "dot", "lof"):
        scores = by_id(vectors.mean_distance(df, metric=metric), key="vec_id")
        top = sorted(scores, key=scores.get)[-16:]
        assert len(swapped & set(top)) >= 4, metric
    flags, votes = vectors.projection_ensemble(df, df, dims=(3, 4), seeds=(1, 2))
    flagged = {i for i, f in by_id(flags, "flag", "vec_id").items() if f}
    assert len(flagged & swapped) >= 7
    assert votes.select("model").distinct().count() == 5
    with pytest.raises(ValueError):
        vectors.mean_distance(df, metric="none")


def test_vector_detectors_on_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.knn_entropy(df).count() == vectors.knn_flagger(df).count() == vectors.mean_distance(df).count() == 0


SENTENCES = ["they dock in Oslo at noon".split(), "ships dock in Oslo at noon today".split(), "ships dock in Oslo at dawn".split(), "Old boats dock in Bergen at noon".split()]
TAGS = ["P V E N E N".split(), "N V E N E N T".split(), "N V E V E N".split(), "A N V E N E N".split()]


def n_gram_flags(sentences, tags):
    """``{(sentence, position): correction}`` by listing every n-gram of two or more tokens."""
    found = {}
    for s, (words, own) in enumerate(zip(sentences, tags)):
        for b in range(len(words)):
            for e in range(b + 2, len(words) + 1):
                left = words[b - 1] if b else ("edge", s)
                right = words[e] if e < len(words) else ("edge", s)
                found.setdefault(tuple(words[b:e]), []).append((s, b, tuple(own[b:e]), left, right))
    fixes = {}
    for gram, places in found.items():
        seen = [p[2] for p in places]
        if min(len({p[k] for p in places}) for k in (2, 3, 4)) < 2:
            continue
        best = max(set(seen), key=lambda t: (seen.count(t), -seen.index(t)))
        for s, b, own, _, _ in places:
            for k, (x, y) in enumerate(zip(own, best)):
                if x != y:
                    fixes.setdefault((s, b + k), []).append((-len(places), "\u0001".join(gram), y))
    return {place: max(options)[2] for place, options in fixes.items()}


def test_variation_n_grams(spark):
    tokens = spark.createDataFrame(token_rows(SENTENCES, TAGS), "sent_id long, pos int, token string, noisy string")
    found = sequences.variation_n_grams(tokens.withColumn("form", F.lower("token")), "form", "noisy")
    # "dock in oslo at" stands in three contexts, and only the third tags "oslo" as V
    assert {(r.sent_id, r.pos): r.corrected for r in found.collect() if r.flag} == {(2, 3): "N"}
    assert found.count() == 26
    assert sequences.variation_n_grams(tokens.limit(0), "token", "noisy").count() == 0


@pytest.mark.parametrize("room", [0, 32])
def test_variation_n_grams_equal_a_list_of_all(spark, monkeypatch, room):
    monkeypatch.setattr(sequences, "ROOM", room)
    rng = random.Random(21)
    for words, size in (("ab", 6), ("abc", 12), ("abcdef", 30)):
        sentences = [[rng.choice(words) for _ in range(rng.randint(1, size))] for _ in range(12)]
        sentences += [list(sentences[0]), [*sentences[1], "z"], ["y", *sentences[1]]]
        tags = [[rng.choice("MMMN") for _ in s] for s in sentences]
        tokens = spark.createDataFrame(token_rows(sentences, tags), "sent_id long, pos int, token string, noisy string")
        found = {(r.sent_id, r.pos): r.corrected for r in sequences.variation_n_grams(tokens, "token", "noisy").collect() if r.flag}
        assert found == n_gram_flags(sentences, tags)


def test_variation_n_grams_of_long_copies(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**9)}" for _ in range(10_000)]
    tags = [rng.choice("MN") for _ in words]
    odd = [t if k % 1_000 else "X" for k, t in enumerate(tags)]
    rows = token_rows([words, ["begin", *words], [*words, "end"]], [tags, ["N", *odd], [*tags, "N"]])
    tokens = spark.createDataFrame([*rows, (None, 1, "w", "N"), (7, None, "w", "N")], "sent_id long, pos int, token string, noisy string").repartition(8)
    found = sequences.variation_n_grams(tokens, "token", "noisy")
    assert {(r.sent_id, r.pos): r.corrected for r in found.where("flag").collect()} == {(1, k + 1): tags[k] for k in range(0, 10_000, 1_000)}
    assert found.count() == len(rows) + 2


def test_variation_n_grams_span(spark):
    texts = ["we met Ada Byron in Turin", "you met Ada Byron in Rome", "he met Ada Byron in Turin", "Turin is old", "Turin is wet", "Turin is old"]
    tags = ["O O B-HUM I-HUM O B-TOWN", "O O B-HUM I-HUM O B-TOWN", "O O B-ORG I-ORG O B-LAND", "B-TOWN O O", "B-LAND O O", "B-TOWN O O"]
    rows = token_rows([t.split() for t in texts], [t.split() for t in tags])
    tokens = spark.createDataFrame(rows, "sent_id long, pos int, token string, tag string").withColumn("form", F.lower("token"))
    found = sequences.variation_n_grams_span(tokens, spans.bio_spans(tokens, "tag"), "form").orderBy("sent_id", "start_pos").collect()
    # contexts: "met ada byron in" (HUM twice, ORG once), "in turin" (a tie, TOWN first), "in rome", "turin is" (TOWN twice, LAND once)
    assert [int(r.flag) for r in found] == [0, 0, 0, 0, 1, 1, 0, 1, 0]
    assert [r.corrected for r in found] == ["HUM", "TOWN", "HUM", "TOWN", "HUM", "TOWN", "TOWN", "TOWN", "TOWN"]


@pytest.mark.parametrize("alphabet,size", [("a", 2), ("ab", 2), ("ab", 3), ("abc", 1), ("abc", 4)])
def test_sublists(spark, alphabet, size):
    rng = random.Random(size)
    pairs = [([rng.choice(alphabet) for _ in range(rng.randint(0, 12))], [rng.choice(alphabet) for _ in range(size)]) for _ in range(20)]
    df = spark.createDataFrame([(k, h, n) for k, (h, n) in enumerate(pairs)], "id int, h array<string>, n array<string>")
    found = {r.id: [tuple(x) for x in r.x] for r in df.select("id", sequences.occurrences(F.col("h"), F.col("n")).alias("x")).collect()}
    assert found == {k: [(b, b + size) for b in range(len(h)) if h[b : b + size] == n] for k, (h, n) in enumerate(pairs)}


def test_ragged_round_trip(spark):
    tokens = spark.createDataFrame(token_rows(SENTENCES, TAGS), "sent_id long, pos int, token string, noisy string")
    back = sequences.flatten(sequences.unflatten(tokens.repartition(5), ["token", "noisy"]), ["token", "noisy"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tokens.collect()))
    assert sequences.first_sentences(tokens, 2).count() == 13
    with pytest.raises(IndexError):
        sequences.first_sentences(tokens, 5)


def test_bio_repair(spark):
    tags = "I-A I-A I-B B-B O I-A X B-A".split()
    df = spark.createDataFrame([(1, p, t) for p, t in enumerate(tags)] + [(2, 0, None), (2, 1, "I-C")], "sent_id long, pos int, tag string")
    found = sorted(map(tuple, spans.bio_spans(df, "tag").collect()))
    assert found == [(1, 0, 2, "A"), (1, 2, 3, "B"), (1, 3, 4, "B"), (1, 5, 6, "A"), (1, 7, 8, "A"), (2, 1, 2, "C")]


def test_span_matching_takes_the_larger_overlap():
    assert spans.best_matching([(0, 4), (6, 7)], [(0, 1), (2, 5), (5, 6)]) == {0: 1}
    assert spans.best_matching([], [(0, 1)]) == {}


def test_span_matching_equals_exhaustive_search():
    rng = random.Random(8)

    def draw():
        at, found = 0, []
        for _ in range(rng.randint(0, 4)):
            begin = at + rng.randint(0, 3)
            at = begin + rng.randint(1, 4)
            found.append((begin, at))
        return found

    def overlap(x, y):
        return max(0, min(x[1], y[1]) - max(x[0], y[0]))

    for _ in range(300):
        a, b = draw(), draw()
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        best = max((sum(overlap(x, y) for x, y in zip(small, p)) for p in itertools.permutations(large, len(small))), default=0)
        pairs = spans.best_matching(a, b)
        assert sum(overlap(a[i], b[j]) for i, j in pairs.items()) == best
        assert all(overlap(a[i], b[j]) for i, j in pairs.items()) and len(set(pairs.values())) == len(pairs)


def test_span_alignment(spark):
    words = [["Lake", "Garda", "is", "deep"], ["old", "Lima", "slept"]]
    gold = [["B-SEA", "I-SEA", "O", "O"], ["O", "B-TOWN", "O"]]
    noisy = [["O", "B-SEA", "O", "B-TOWN"], ["O", "B-LAND", "I-LAND"]]
    df = spark.createDataFrame(token_rows(words, gold, noisy), "sent_id long, pos int, token string, gold string, noisy string")
    rows = spans.align_span_data(df, "token", "gold", "noisy").orderBy("sent_id", "start_pos").collect()
    assert [(r.surface_form, r.gold, r.noisy, r.gold_end) for r in rows] == [("Lake Garda", "SEA", "SEA", 2), ("deep", spans.NO_ALIGNMENT, "TOWN", None), ("Lima", "TOWN", "LAND", 2)]


def _odd_tagging(spark):
    """Tags and lists of probabilities with gaps, nulls, several lengths, a sentence of several batches and one without spans."""
    draw = random.Random(5)
    tags = ["O", "B-X", "I-X", "B-Y", "I-Y", None, "I-"]
    rows = []
    for sent in [*range(60), None]:
        for pos in sorted(draw.sample(range(40), draw.randrange(1, 25))) if sent != 7 else range(200):
            p = draw.choice([None, [], [0.5], [None, 0.25, 1.0], [draw.random() for _ in range(5)], [draw.random() for _ in range(7)], [None] * 4])
            gold = draw.choice(tags)
            rows.append((sent, pos, "O" if sent == 3 else gold if draw.random() < 0.7 else draw.choice(tags), gold, p))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "sent_id long, pos int, noisy string, gold string, probs array<double>")


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _as_set(df, key):
    return sorted(map(repr, ((*r[:key], None if r[key] is None else [x and round(x, 9) for x in r[key]] if isinstance(r[key], list) else round(r[key], 9)) for r in df.collect())))


def test_tagged_results_equal_those_of_joined_spans(spark, small_batches):
    df = _odd_tagging(spark)
    classes = spark.createDataFrame([(0, "O"), (1, "B-X"), (2, "I-X"), (3, "B-Y"), (5, "I-Y"), (9, "B-Z")], "idx int, label string")
    turned = df.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("probs", F.transform("probs", lambda p: p / (1 + F.col("t"))))
    turns = {0: F.col("probs"), 1: F.transform("probs", lambda p: p / 2)}
    noisy, gold = spans.bio_spans(df, "noisy"), spans.bio_spans(df, "gold")
    _, once, repeated = spans.align_span_result(noisy, gold, df.select("sent_id", "pos", "probs"), classes, turned.select("sent_id", "pos", "t", "probs"))
    for found, expected in ((spans.align_tagged_result(df, "noisy", "gold", F.col("probs"), classes), once), (spans.align_tagged_result(df, "noisy", "gold", turns, classes), repeated)):
        assert found.dtypes == expected.dtypes
        assert _as_set(found, len(found.columns) - 1) == _as_set(expected, len(found.columns) - 1) != []
    assert spans.align_tagged_result(df.limit(0), "noisy", "gold", F.col("probs"), classes).count() == 0


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_repeated_span_results_shuffle_tokens_once(spark):
    assert _shuffles(detectors.span_result_repeated(spark, "/root/testdata/sf0.001")) == 1


def test_tagged_vectors_equal_those_of_joined_spans(spark, small_batches):
    df = _odd_tagging(spark).withColumnRenamed("probs", "vec")
    found, expected = spans.embed_tagged(df, "noisy", F.col("vec")), spans.embed_spans(spans.bio_spans(df, "noisy"), df.select("sent_id", "pos", "vec"))
    assert found.dtypes == expected.dtypes
    assert _as_set(found, 4) == _as_set(expected, 4) != []


def test_span_vectors_shuffle_tokens_once(spark):
    assert _shuffles(detectors.span_vectors(spark, "/root/testdata/sf0.001")) == 1


def test_span_results(spark):
    classes = spark.createDataFrame(list(enumerate(["O", "B-P", "I-P"])), "idx int, label string")
    noisy = spark.createDataFrame([(0, 0, 2, "P"), (1, 1, 2, "P")], "sent_id long, start_pos int, end_pos int, type string")
    predicted = spark.createDataFrame([(0, 1, 2, "P")], noisy.schema)
    probs = spark.createDataFrame([(0, 0, [1.0, 0.0, 0.0]), (0, 1, [0.0, 0.5, 0.5]), (1, 1, [0.2, 0.2, 0.6])], "sent_id long, pos int, probs array<double>")
    repeated = probs.crossJoin(spark.range(2).selectExpr("cast(id as int) as t"))
    aligned, p, rep = spans.align_span_result(noisy, predicted, probs, classes, repeated)
    assert by_id(aligned, "prediction", "sent_id") == {0: "P", 1: "O"}
    assert {(r.sent_id, r.type): round(r.p, 6) for r in p.collect()} == {(0, "O"): 0.0, (0, "P"): 0.5, (1, "O"): 0.2, (1, "P"): 0.4}
    assert rep.count() == 8
    scores = probs.select("sent_id", "pos", F.get("probs", F.lit(0)).alias("score"))
    assert by_id(spans.aggregate_scores(noisy, scores), key="sent_id") == {0: 0.5, 1: 0.2}
    assert by_id(spans.aggregate_scores(noisy, scores, F.max), key="sent_id") == {0: 1.0, 1: 0.2}
    vecs = spans.embed_spans(noisy, probs.withColumnRenamed("probs", "vec"))
    assert by_id(vecs, "vec", "sent_id")[0] == [0.5, 0.25, 0.25]


def test_training_dynamics(spark):
    rows, df = cloud(spark, 90)
    swapped = {i for i, _, _ in rows if i % 15 == 0}
    scores = by_id(dynamics.datamap_confidence(dynamics.train_log(df, epochs=10)))
    assert len(scores) == 90 and len(set(sorted(scores, key=scores.get)[-8:]) & swapped) >= 4
    for spotter in (dynamics.curriculum_spotter, dynamics.leitner_spotter):
        scores = by_id(spotter(df, epochs=6), key="vec_id")
        again = by_id(spotter(df.repartition(5), epochs=6), key="vec_id")
        assert len(scores) == 90 and all(s >= 0 for s in scores.values())
        assert scores == pytest.approx(again)
    leitner = by_id(dynamics.leitner_spotter(df, epochs=8), key="vec_id")
    assert len(set(sorted(leitner, key=leitner.get)[-10:]) & swapped) >= 4


@pytest.mark.parametrize("most,bins", [(10_000, 1024), (5, 4), (2, 2)])
def test_smallest_rows_are_found_by_bins(spark, monkeypatch, most, bins):
    monkeypatch.setattr(dynamics, "MAX_SORTED", most)
    monkeypatch.setattr(dynamics, "BINS", bins)
    rng = random.Random(most)
    rows = sorted((round(rng.choice([0.5, rng.random(), rng.expovariate(1)]), 3), i) for i in range(60))
    df = spark.createDataFrame(rows, "loss double, id long").repartition(3)
    for k in (0, 1, 7, 25, 59, 60, 99):
        assert dynamics.smallest(df, k) == ((*rows[min(k, 60) - 1], min(k, 60)) if k else (-np.inf, -1, 0))
    assert dynamics.smallest(df.limit(0), 3) == (-np.inf, -1, 0)


def test_folds_are_balanced(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(100)], "id long, noisy string")
    folds = crossval.stratified_folds(df, "id", "noisy", 4)
    counts = folds.join(df, "id").groupBy("noisy", "fold").count().collect()
    for label in "ab":
        sizes = [r["count"] for r in counts if r.noisy == label]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_cross_validation_and_callbacks(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id long, noisy string")
    seen = []

    class Watch(crossval.Callback):
        def on_after_fitting(self, fold, model):
            seen.append(fold)

        def on_after_predicting(self, fold, predicted):
            return predicted.withColumn("fold_seen", F.lit(fold))

    fit = lambda train: lambda rows, n=train.count(): rows.select("id", F.lit(n).alias("n"))
    got = crossval.cross_validate(df, crossval.stratified_folds(df, "id", "noisy", 4), "id", fit, 4, (Watch(),)).collect()
    assert seen == [0, 1, 2, 3] and {r.n for r in got} == {30} and len({r.id for r in got}) == 40
    single = crossval.cross_validate(df, crossval.stratified_folds(df, "id", "noisy", 1), "id", fit, 1).collect()
    assert len(single) == 40 and {r.n for r in single} == {40}


def test_repeated_probabilities_sum_to_one(spark, probs):
    rows = crossval.perturbed_probabilities(probs, "id", 7).collect()
    assert len(rows) == 21 and all(sum(r.probs) == pytest.approx(1) for r in rows)
    drawn = crossval.random_probabilities(probs, "id", 4, repetitions=3).collect()
    assert len(drawn) == 9 and len({tuple(r.probs) for r in drawn}) == 9


def test_metrics(spark):
    rows = [(1, True, True, 0.9), (2, True, False, 0.8), (3, False, True, 0.7), (4, False, False, 0.1), (5, None, True, None)]
    df = spark.createDataFrame(rows, "id long, flag boolean, is_error boolean, score double")
    assert tuple(metrics.flag_quality(df).first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert metrics.percentage_flagged(df).first().share == 0.5
    found = metrics.ranked_quality(df, "id", share=0.5).first()
    assert found.average_precision == pytest.approx((1 + 2 / 3) / 2) and found.precision_at == 0.5 and found.recall_at == 0.5
    assert tuple(metrics.ranked_quality(df.limit(0), "id").first()) == (0.0, 0.0, 0.0)
    assert tuple(metrics.flag_quality(df.limit(0)).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_calibration_lowers_the_error_of_overconfident_rows(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        y = rng.randrange(2)
        top = y if rng.random() < 0.7 else 1 - y
        rows.append((i, i % 3, [0.98, 0.02] if top == 0 else [0.02, 0.98], y))
    df = spark.createDataFrame(rows, "id long, fold int, probs array<double>, idx int")
    before = metrics.expected_calibration_error(df, "probs", "idx").first().ece
    calibrated = metrics.calibrate(df, metrics.fit_temperatures(df, "fold", "probs", "idx"), "fold", "probs")
    after = metrics.expected_calibration_error(calibrated, "calibrated", "idx").first().ece
    assert before > 0.2 and after < 0.05
    assert all(sum(r.calibrated) == pytest.approx(1) for r in calibrated.limit(5).collect())


def isotonic(hits, n):
    """Pooled neighbours until no share falls."""
    blocks = []
    for h, m in zip(hits, n):
        blocks.append([h, m, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            h, m, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h, blocks[-1][1] + m, blocks[-1][2] + size]
    return [h / m for h, m, size in blocks for _ in range(size)]


def test_bin_shares(spark):
    rng = random.Random(13)
    rows = []
    for i in range(900):
        p = rng.random()
        rows.append((i, i % 2, [p, 1 - p], 0 if rng.random() < 0.2 + 0.5 * p else 1))
    df = spark.createDataFrame(rows, "id long, fold int, probs array<double>, idx int")
    for steady in (False, True):
        for found in metrics.bin_shares(df, "fold", "probs", "idx", 10, isotonic=steady).collect():
            own = [(int(p[0] * 10), y == 0) for _, f, p, y in rows if f == found.fold]
            n = [sum(b == k for b, _ in own) for k in range(10)]
            hits = [sum(b == k and y for b, y in own) for k in range(10)]
            expected = isotonic(hits, n) if steady else [h / m for h, m in zip(hits, n)]
            assert [found.shares[(0, k)] for k in range(10)] == pytest.approx(expected)
    for method, (fit, apply) in metrics.CALIBRATORS.items():
        after = apply(df, fit(df, "fold", "probs", "idx"), "fold", "probs")
        assert metrics.expected_calibration_error(after, "calibrated", "idx").first().ece < 0.12, method
        assert all(sum(r.calibrated) == pytest.approx(1) for r in after.limit(5).collect())


def test_one_bundle_for_all_detectors(spark, classes):
    rng = random.Random(14)
    ids, names = range(24), "ABC"
    frame = spark.createDataFrame
    noisy = {i: rng.choice(names) for i in ids}
    p = {i: [rng.random() for _ in names] for i in ids}
    bundle = {
        "instances": frame([(i, f"text {i % 5}", noisy[i]) for i in ids], "id long, text string, noisy string"),
        "classes": classes,
        "probs": frame([(i, p[i]) for i in ids], "id long, probs array<double>"),
        "rep_probs": frame([(i, t, [rng.random() for _ in names]) for i in ids for t in range(3)], "id long, t int, probs array<double>"),
        "preds": frame([(i, m, 0, rng.choice(names)) for i in ids for m in range(3)], "id long, model int, fold int, prediction string"),
        "scores": frame([(s, i, rng.random()) for s in "xy" for i in ids], "scorer string, id long, score double"),
        "vectors": frame([(i, [rng.random() for _ in range(4)], noisy[i]) for i in ids], "id long, vec array<float>, noisy string"),
        "tokens": frame(token_rows(SENTENCES, [["B-X"] * len(s) for s in SENTENCES]), "sent_id long, pos int, token string, noisy string"),
        "train_log": frame([(e, i, 0, 0.5, p[i]) for e in range(2) for i in ids], "epoch int, id long, idx int, loss double, probs array<double>"),
        "unknown": classes,
    }
    slow = {"curriculum_spotter", "leitner_spotter", "projection_ensemble"}
    found = registry.run_all(bundle, sorted(registry.DETECTORS.keys() - slow))
    for name, result in found.items():
        assert registry.DETECTORS[name].kind.value in result.columns, name
        assert ("corrected" in result.columns) == registry.DETECTORS[name].supports_correction, name
        assert result.count() >= 24, name
    assert registry._CALLS.keys() == registry.DETECTORS.keys()
    assert set(registry.run_all({"probs": bundle["probs"]})) == {"classification_entropy", "prediction_margin"}
    with pytest.raises(ValueError):
        registry.run_all({"probs": bundle["probs"]}, ["retag"])


def test_noise_rates(spark, classes):
    df = spark.range(4_000).select("id", F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")).alias("gold"))
    flipped = df.join(noise.flipped_label_noise(df, "id", "gold", classes, 0.1), "id")
    changed = flipped.where("gold <> noisy")
    assert abs(changed.count() / 4_000 - 0.1) < 0.02
    counts = [r["count"] for r in changed.groupBy("gold", "noisy").count().collect()]
    assert len(counts) == 6 and min(counts) > 30
    uniform = df.join(noise.uniform_label_noise(df, "id", "gold", classes, 0.3), "id").where("gold <> noisy").count()
    assert abs(uniform / 4_000 - 0.2) < 0.03
    odd = spark.createDataFrame([(1, "Z"), (2, None)], "id long, gold string")
    assert by_id(noise.flipped_label_noise(odd, "id", "gold", classes, 1.0), "noisy") == {1: "Z", 2: None}


def test_results_do_not_depend_on_partitions(spark, forms):
    for operator in (labels.label_entropy, labels.weighted_discrepancy):
        assert by_id(operator(forms, "id", "form", "noisy")) == by_id(operator(forms.repartition(7), "id", "form", "noisy"))
