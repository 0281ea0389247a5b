"""Detectors that combine several models or scorers: votes, ranks, label aggregation, item response theory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.operators.ranking import global_rank
from tagsieve.plans.runtime import checkpoint

#: Distinct answer patterns that are aggregated on the driver; more stay distributed.
MAX_LOCAL_PATTERNS = 200_000


def latest_predictions(preds: DataFrame) -> DataFrame:
    """One prediction for each ``(id, model)``: the last run, then the smallest; null ones are no prediction."""
    last = F.max_by("prediction", F.struct(F.col("run_at"), F.col("prediction")))
    order = preds.where("prediction is not null").groupBy("id", "model")
    return order.agg(last.alias("prediction"))


def majority_vote(predictions: DataFrame, row_id: str = "id") -> DataFrame:
    """``(row_id, corrected)``: the most frequent prediction, ties to the smallest."""
    counts = predictions.where("prediction is not null").groupBy(row_id, "prediction").agg(F.count("*").alias("n"))
    top = counts.groupBy(row_id).agg(F.max("n").alias("top"))
    return counts.join(top, row_id).where("n = top").groupBy(row_id).agg(F.min("prediction").alias("corrected"))


def majority_voting_ensemble(df: DataFrame, predictions: DataFrame, row_id: str = "id", label: str = "noisy") -> DataFrame:
    """``(row_id, flag, corrected)`` for every row with a prediction: label differs from the vote."""
    voted = df.select(row_id, label).join(majority_vote(predictions, row_id), row_id)
    return voted.select(row_id, (F.col(label) != F.col("corrected")).alias("flag"), "corrected")


def borda_count(scores: DataFrame, row_id: str = "id") -> DataFrame:
    """``(row_id, score)`` from ``(scorer, row_id, score)``: the sum of the rows' ranks by each scorer.

    The highest score of n gets n points; ties are ranked by ``row_id``; null scores get none.
    """
    rounded = scores.where("score is not null").select("scorer", row_id, F.round("score", 9).alias("score"))
    ranked = global_rank(rounded, [F.col("score"), F.col(row_id)], "points", ["scorer"])
    return ranked.groupBy(row_id).agg(F.sum("points").alias("score"))


def answer_patterns(votes: DataFrame, row_id: str, workers: int) -> tuple[DataFrame, DataFrame]:
    """Rows by their pattern of votes ``(row_id, worker, label)``: ``(row_id, pattern)`` and ``(pattern, n)``.

    A pattern holds, for every worker, the voted class or -1. Tasks with the same pattern
    have the same estimate, so iterations only run over distinct patterns.
    """
    # rows are read for the patterns and again for the answers, so they are kept
    slots = [F.coalesce(F.max(F.when(F.col("worker") == w, F.col("label"))), F.lit(-1)).cast("int") for w in range(workers)]
    rows = checkpoint(votes.groupBy(row_id).agg(F.array(*slots).alias("pattern")))
    return rows, rows.groupBy("pattern").agg(F.count("*").alias("n"))


def _expect(patterns: np.ndarray, prior: np.ndarray, confusion: np.ndarray) -> np.ndarray:
    """Class probabilities of each pattern; ``confusion`` is by worker, true and voted class."""
    score = np.tile(np.log(np.maximum(prior, 1e-10)), (len(patterns), 1))
    for worker, table in enumerate(np.log(np.maximum(confusion, 1e-10))):
        voted = patterns[:, worker]
        score += np.where(voted[:, None] >= 0, table[:, np.maximum(voted, 0)].T, 0.0)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def _count(patterns: np.ndarray, weighted: np.ndarray, classes: int) -> np.ndarray:
    """Expected votes by worker, true and voted class, and at the end the class totals."""
    sums = np.zeros((patterns.shape[1] + 1, classes, classes))
    for worker in range(patterns.shape[1]):
        for voted in range(classes):
            sums[worker, :, voted] = weighted[patterns[:, worker] == voted].sum(axis=0)
    sums[-1, :, 0] = weighted.sum(axis=0)
    return sums


def _initial(patterns: np.ndarray, classes: int) -> np.ndarray:
    votes = np.stack([(patterns == c).sum(axis=1) for c in range(classes)], axis=1).astype(float)
    return votes / np.maximum(votes.sum(axis=1, keepdims=True), 1)


def _maximise(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    totals = sums[-1, :, 0]
    rows = sums[:-1].sum(axis=2, keepdims=True)
    return totals / max(totals.sum(), 1e-300), np.divide(sums[:-1], rows, out=np.zeros_like(sums[:-1]), where=rows > 0)


def _arrays(frame) -> tuple[np.ndarray, np.ndarray]:
    return np.array(frame["pattern"].tolist(), np.int64), frame["n"].to_numpy(float)


def dawid_skene(patterns: DataFrame, workers: int, classes: int, iterations: int = 100, max_local: int = MAX_LOCAL_PATTERNS):
    """Class prior and confusion matrices by expectation maximisation from the majority vote.

    Nothing is smoothed, likelihoods are at least 1e-10, and the number of iterations is
    fixed. Up to ``max_local`` distinct patterns are iterated on the driver; more stay in
    the cluster and only the expected counts travel.
    """
    state: tuple[np.ndarray, np.ndarray] | None = None
    if patterns.limit(max_local + 1).count() <= max_local:
        local = _arrays(patterns.toPandas()) if not patterns.isEmpty() else (np.zeros((0, workers), np.int64), np.zeros(0))
        for _ in range(iterations + 1):
            expected = _initial(local[0], classes) if state is None else _expect(local[0], *state)
            state = _maximise(_count(local[0], expected * local[1][:, None], classes))
        return state
    kept = checkpoint(patterns)
    for _ in range(iterations + 1):
        shared = kept.sparkSession.sparkContext.broadcast(state)

        def partial(frames: Iterator, shared=shared) -> Iterator:
            import pandas as pd

            total = np.zeros((workers + 1, classes, classes))
            for frame in frames:
                own, n = _arrays(frame)
                expected = _initial(own, classes) if shared.value is None else _expect(own, *shared.value)
                total += _count(own, expected * n[:, None], classes)
            yield pd.DataFrame({"at": np.arange(total.size), "x": total.ravel()})

        rows = kept.mapInPandas(partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros((workers + 1) * classes * classes)
        flat[rows["at"].to_numpy()] = rows["x"].to_numpy()
        state = _maximise(flat.reshape(workers + 1, classes, classes))
    return state


def label_aggregation(df: DataFrame, votes: DataFrame, labels: list[str], workers: int, row_id: str = "id", label: str = "noisy", iterations: int = 100) -> DataFrame:
    """``(row_id, flag, corrected)``: the label differs from the most probable class of the votes.

    ``votes`` has ``(row_id, worker, label)`` with workers from 0 and class numbers; ties go
    to the lowest class. Rows without votes are left out.
    """
    rows, patterns = answer_patterns(votes, row_id, workers)
    shared = df.sparkSession.sparkContext.broadcast(dawid_skene(patterns, workers, len(labels), iterations))

    @F.pandas_udf("string")
    def best(pattern):
        import pandas as pd

        found = _expect(np.array(pattern.tolist(), np.int64).reshape(len(pattern), workers), *shared.value)
        return pd.Series([labels[k] for k in np.round(found, 12).argmax(axis=1)])

    joined = df.select(row_id, label).join(rows, row_id).withColumn("corrected", best("pattern"))
    return joined.select(row_id, (F.col(label) != F.col("corrected")).alias("flag"), "corrected")


def fit_items(patterns: np.ndarray, ability: np.ndarray, steps: int = 200) -> np.ndarray:
    """Discrimination and difficulty of each answer pattern, at the mode given the abilities.

    Two-parameter logistic ``a (ability - b)`` with standard normal priors on both, climbed
    from ``a = b = 0`` (a small nudge decides the side) by fixed gradient steps.
    """
    given = patterns >= 0
    right = np.where(given, patterns, 0)
    a = np.where((right - right.mean(axis=1, keepdims=True)) @ ability >= 0, 0.1, -0.1)
    b = np.zeros(len(patterns))
    for _ in range(steps):
        reach = ability[None, :] - b[:, None]
        miss = np.where(given, right - 1 / (1 + np.exp(-np.clip(a[:, None] * reach, -30, 30))), 0.0)
        a, b = a + 0.1 * ((miss * reach).sum(axis=1) - a), b + 0.1 * (-(miss * a[:, None]).sum(axis=1) - b)
    return np.stack([a, b], axis=1)


def _answer_sums(patterns: np.ndarray, n: np.ndarray, ability: np.ndarray | None) -> np.ndarray:
    """By model: right and given answers at first, and the slope of the likelihood in the abilities then."""
    given = patterns >= 0
    if ability is None:
        return np.stack([(np.where(given, patterns, 0) * n[:, None]).sum(axis=0), (given * n[:, None]).sum(axis=0)])
    items = fit_items(patterns, ability)
    chance = 1 / (1 + np.exp(-np.clip(items[:, :1] * (ability[None, :] - items[:, 1:]), -30, 30)))
    return (np.where(given, patterns - chance, 0.0) * items[:, :1] * n[:, None]).sum(axis=0)[None, :]


def item_response_flags(
    df: DataFrame, predictions: DataFrame, models: int, row_id: str = "id", label: str = "noisy", rounds: int = 25, max_local: int = MAX_LOCAL_PATTERNS
) -> DataFrame:
    """``(row_id, flag)``: items whose discrimination is negative.

    A model answers an item right if it predicts the given label. Items share parameters
    if their answers agree, so the fit runs over at most ``3 ** models`` answer patterns.
    Deterministic: abilities start at the standardised share of right answers. Up to
    ``max_local`` patterns are fitted on the driver; more stay in the cluster, and only
    sums by model travel.
    """
    right = F.when(F.col("prediction") == F.col(label), 1).otherwise(0)
    answers = df.select(row_id, label).where(F.col(label).isNotNull()).join(predictions, row_id)
    votes = answers.where("prediction is not null").select(row_id, F.col("model").alias("worker"), right.alias("label"))
    rows, counted = answer_patterns(votes, row_id, models)
    counted = checkpoint(counted)
    total, few = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], counted.count() <= max_local
    local = _arrays(counted.toPandas()) if few and total else None

    def sums(ability: np.ndarray | None) -> np.ndarray:
        if local:
            return _answer_sums(*local, ability)

        def partial(frames: Iterator) -> Iterator:
            import pandas as pd

            for frame in frames:
                if len(frame):
                    found = _answer_sums(*_arrays(frame), ability)
                    yield pd.DataFrame({"at": np.arange(found.size), "x": found.ravel()})

        added = counted.mapInPandas(partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toPandas()
        return added["x"].to_numpy().reshape(-1, models)

    ability = np.zeros(models)
    if total:
        answered = sums(None)
        share = answered[0] / np.maximum(answered[1], 1)
        ability = (share - share.mean()) / max(share.std(), 1e-9)
        for _ in range(rounds):
            ability = ability + 0.5 * (sums(ability)[0] - ability) / total

    def negative(frames: Iterator) -> Iterator:
        for frame in frames:
            if len(frame):
                yield frame[["pattern"]].assign(flag=fit_items(_arrays(frame)[0], ability)[:, 0] < 0)

    flags = counted.mapInPandas(negative, "pattern array<int>, flag boolean")
    return rows.join(F.broadcast(flags) if few else flags, "pattern").select(row_id, "flag")
