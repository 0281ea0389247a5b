"""Folds, out-of-fold predictions and repeated inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsieve.functions.arrays import hash_unit, unit_sum
from tagsieve.operators.ranking import global_rank
from tagsieve.plans.runtime import stored


#: Labels whose class means come to the driver and are broadcast.
MAX_CLASSES = 10_000
#: Folds whose models are fitted at a time.
PARALLEL = 5
#: Share of the driver's heap that the fits of that time may take, by their ``driver_bytes``.
HEAP_SHARE = 0.7


class Callback:
    """Hooks of a cross-validation; each gets the fold and the frames of that moment."""

    def on_begin(self, folds: int) -> None: ...

    def on_before_fitting(self, fold: int, train: DataFrame) -> None: ...

    def on_after_fitting(self, fold: int, model: object) -> None: ...

    def on_before_predicting(self, fold: int, holdout: DataFrame) -> None: ...

    def on_after_predicting(self, fold: int, predicted: DataFrame) -> DataFrame | None: ...


def stratified_folds(df: DataFrame, row_id: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """``(row_id, fold)``: within every label the folds differ by at most one row.

    Rows of a label are dealt out in the order of a seeded hash of their integer id. A
    null label is a label of its own.
    """
    rows = df.select(row_id, F.col(label).alias("stratum"), hash_unit(seed, F.col(row_id)).alias("h"))
    ranked = global_rank(rows, [F.col("h"), F.col(row_id)], "place", ["stratum"])
    return ranked.select(row_id, F.pmod(F.col("place") - 1, F.lit(k)).cast("int").alias("fold"))


def plain_folds(df: DataFrame, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """``(row_id, fold)`` of every distinct id, for sentences: dealt out by a seeded hash, so that folds differ by at most one."""
    ids = df.select(row_id).distinct().select(row_id, hash_unit(seed, F.col(row_id)).alias("h"))
    ranked = global_rank(ids, [F.col("h"), F.col(row_id)], "place")
    return ranked.select(row_id, F.pmod(F.col("place") - 1, F.lit(k)).cast("int").alias("fold"))


def cross_validate(df: DataFrame, folds: DataFrame, row_id: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], k: int, callbacks: tuple[Callback, ...] = ()) -> DataFrame:
    """Out-of-fold output of a model for every row.

    ``fit`` takes training rows and returns a function from rows to predictions. With
    ``k = 1`` the model is trained on all rows and predicts them. A callback may replace
    the predictions of a fold. Rows are joined with their folds once and written by fold,
    so that each model reads the folds that it needs. Without callbacks up to ``PARALLEL``
    models are fitted at a time, as their jobs don't depend on each other, but no more than
    the driver's heap holds if ``fit.driver_bytes`` tells what one takes there. A ``fit.folds``
    takes all rows with their folds and fits the models of all folds itself; a ``fit.out_of_fold``
    also predicts.
    """
    assigned = stored(df.join(folds, row_id).withColumn("fold", F.col("fold").cast("int")), "fold")
    if not callbacks and k > 1 and hasattr(fit, "out_of_fold"):
        return fit.out_of_fold(assigned, k)
    parts = [(assigned.where(F.col("fold") != f), assigned.where(F.col("fold") == f)) if k > 1 else (assigned, assigned) for f in range(k)]
    fitted: list = []
    if not callbacks and k > 1 and hasattr(fit, "folds"):
        fitted = fit.folds(assigned, k)
    elif not callbacks and k > 1:
        heap = df.sparkSession._jvm.java.lang.Runtime.getRuntime().maxMemory()
        fitting = max(1, min(k, PARALLEL, int(HEAP_SHARE * heap / getattr(fit, "driver_bytes", 1))))
        with ThreadPoolExecutor(fitting) as pool:
            fitted = [pool.submit(inheritable_thread_target(df.sparkSession)(fit), train) for train, _ in parts]
            fitted = [f.result() for f in fitted]
    for callback in callbacks:
        callback.on_begin(k)
    result = None
    for fold, (train, holdout) in enumerate(parts):
        for callback in callbacks:
            callback.on_before_fitting(fold, train)
        model = fitted[fold] if fitted else fit(train)
        for callback in callbacks:
            callback.on_after_fitting(fold, model)
            callback.on_before_predicting(fold, holdout)
        predicted = model(holdout)
        for callback in callbacks:
            predicted = callback.on_after_predicting(fold, predicted) or predicted
        result = predicted if result is None else result.unionByName(predicted)
    return result


def vector_sums(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """``(keys, n, sums)``: rows and sum of the vectors of each key, added up before they are shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    summed = Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(vector).cast("array<double>"))).alias("__s")
    return df.groupBy(*keys).agg(summed).select(*keys, F.col("__s.count").alias("n"), vector_to_array("__s.sum").alias("sums"))


def centroid_probabilities(df: DataFrame, row_id: str, vector: str, label: str, fold: Column, k: int) -> DataFrame:
    """``(row_id, label, fold, prediction, probs)``: softmax of the negative distance to out-of-fold class means.

    The mean of a class without a fold is its whole sum less that of the fold, so one pass
    over the rows fits all folds. Class sums are bounded by folds, classes and dimensions
    and broadcast; classes stand in label order; ties go to the first class.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(row_id), F.col(label), F.col(vector).alias("v"), fold.cast("int").alias("fold"))
    sums = vector_sums(rows, "v", label, "fold").collect()
    if len({r[label] for r in sums}) > MAX_CLASSES:
        raise ValueError(f"there are more than {MAX_CLASSES} labels")
    names = sorted({r[label] for r in sums})
    width = max((len(r.sums) for r in sums), default=0)
    total, count = np.zeros((k, len(names), width)), np.zeros((k, len(names), 1))
    at = {n: i for i, n in enumerate(names)}
    for r in sums:
        total[r.fold, at[r[label]]], count[r.fold, at[r[label]], 0] = r.sums, r.n
    rest, number = total.sum(axis=0) - total, count.sum(axis=0) - count
    means = np.divide(rest, number, out=np.full_like(rest, np.inf), where=number > 0)
    shared = df.sparkSession.sparkContext.broadcast(means)

    schema = T.StructType([rows.schema[row_id], rows.schema[label], T.StructField("fold", T.IntegerType()), T.StructField("best", T.IntegerType()), T.StructField("probs", T.ArrayType(T.DoubleType(), False))])

    def predict(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            if not len(frame):
                continue
            v = np.stack([np.asarray(x, np.float64) for x in frame["v"]])
            own = shared.value[frame["fold"].to_numpy()]
            distance = np.sqrt(((v[:, None, :] - own) ** 2).sum(axis=2))
            power = np.exp(distance.min(axis=1, keepdims=True) - distance)
            probs = power / power.sum(axis=1, keepdims=True)
            best = np.round(probs, 9).argmax(axis=1).astype(np.int32)
            yield pd.DataFrame({row_id: frame[row_id], label: frame[label], "fold": frame["fold"], "best": best, "probs": list(probs)})

    predicted = rows.mapInPandas(predict, schema)
    classes = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return predicted.select(row_id, label, "fold", F.get(classes, F.col("best")).alias("prediction"), "probs")


def repeat_inference(df: DataFrame, predict: Callable[[DataFrame, Column], DataFrame], repetitions: int) -> DataFrame:
    """``predict`` on every row for each t below ``repetitions``, with t to seed its dropout."""
    turns = df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    return predict(turns, F.col("t") + 23)


def perturbed_probabilities(probs: DataFrame, row_id: str, repetitions: int, strength: float = 0.5, seed: int = 23) -> DataFrame:
    """``(row_id, t, probs)``: repeated rows, each probability scaled by a hash of row, turn and class, then to sum 1.

    Rows without a positive probability are left out.
    """
    usable = probs.where(F.exists("probs", lambda p: p > 0))
    turns = usable.select(row_id, "probs", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("t"))
    scaled = F.transform("probs", lambda p, c: p * (1 - F.lit(strength) * hash_unit(seed, F.col(row_id), F.col("t"), c)))
    return turns.select(row_id, "t", unit_sum(scaled).alias("probs"))


def random_probabilities(df: DataFrame, row_id: str, classes: int, seed: int = 42, repetitions: int = 0) -> DataFrame:
    """Seeded random rows of sum 1 for every id: ``(row_id, probs)``, or ``(row_id, t, probs)`` if repeated."""
    keys = [F.col(row_id)]
    rows = df.select(row_id)
    if repetitions:
        rows = rows.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
        keys.append(F.col("t"))
    drawn = F.array(*[hash_unit(seed, *keys, F.lit(c)) + 1e-9 for c in range(classes)])
    return rows.select(*rows.columns, unit_sum(drawn).alias("probs"))
