"""Detectors over embedding vectors: nearest neighbours, class centroids, local outlier factor, projections.

Vectors are arrays of one length; rows with a null vector or label are left out. Distances
are computed in double precision and rounded to nine digits, so that ties are ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsieve.functions import arrays
from tagsieve.operators.crossval import vector_sums
from tagsieve.operators.skew import skew_join
from tagsieve.plans.runtime import checkpoint

#: Bytes of vectors that are broadcast at once; more rows take more blocks.
BLOCK_BYTES = 64 << 20
#: Rows that a projection model is trained on; all rows are predicted.
MAX_TRAIN_ROWS = 20_000

NEIGHBOURS = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("label", T.StringType())]))


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 0))


def _nearest(queries: np.ndarray, own_labels, block: tuple, k: int, same_label: bool, ids=None) -> list[list[tuple]]:
    """The k nearest of a block for each query; the block is sorted by id, so ties are too."""
    vectors, block_ids, labels = block
    squares = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None, :] - 2 * queries @ vectors.T
    distance = np.round(np.maximum(squares, 0), 9)
    if same_label:
        distance[np.asarray(own_labels)[:, None] != labels[None, :]] = np.inf
    if ids is not None:
        distance[np.asarray(ids)[:, None] == block_ids[None, :]] = np.inf
    k = min(k, distance.shape[1])
    limit = np.partition(distance, k - 1, axis=1)[:, k - 1]
    result = []
    for row, most in zip(distance, limit):
        at = np.flatnonzero(row <= most)
        at = at[np.isfinite(row[at])]
        at = at[np.argsort(row[at], kind="stable")][:k]
        result.append([(float(row[x]), int(block_ids[x]), str(labels[x])) for x in at])
    return result


def nearest_neighbours(
    df: DataFrame, row_id: str, vector: str, label: str, k: int, same_label: bool = False, without_self: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(row_id, label, near)``: the exact k nearest rows of every row by squared distance.

    ``near`` is an array of ``(d, id, label)`` by distance, then id; the row itself is among
    them unless ``without_self``. Fewer rows than k give shorter arrays. Reference rows are
    broadcast in blocks of at most ``block_bytes``; each block yields k candidates a row,
    and the blocks' candidates are merged.
    """
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("y"))
    rows = rows.where("v is not null and y is not null")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-size.n * (size.d or 1) * 8 // block_bytes))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.StringType()), T.StructField("near", NEIGHBOURS)])
    merged = None
    for number in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toPandas().sort_values("id")
        if not len(own):
            continue
        shared = df.sparkSession.sparkContext.broadcast((_matrix(own["v"]), own["id"].to_numpy(), own["y"].to_numpy(str)))

        def search(frames: Iterator, shared=shared) -> Iterator:
            import pandas as pd

            for frame in frames:
                for at in range(0, len(frame), 256):
                    part = frame.iloc[at : at + 256]
                    near = _nearest(_matrix(part["v"]), part["y"].to_numpy(str), shared.value, k, same_label, part["id"] if without_self else None)
                    yield pd.DataFrame({"id": part["id"], "y": part["y"], "near": [[{"d": d, "id": i, "label": y} for d, i, y in x] for x in near]})

        found = rows.mapInPandas(search, schema)
        merged = found if merged is None else merged.unionByName(found)
    if merged is None:
        merged = df.sparkSession.createDataFrame([], schema)
    elif blocks > 1:
        near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")
        merged = merged.groupBy("id", "y").agg(near)
    return merged.select(F.col("id").alias(row_id), F.col("y").alias(label), "near")


def neighbour_classes(near: DataFrame, row_id: str) -> DataFrame:
    """``(row_id, label, p)``: softmin weights of the neighbours' labels."""
    long = near.select(row_id, F.get(F.col("near")["d"], F.lit(0)).alias("least"), F.explode("near").alias("x"))
    weight = F.sum(F.exp(F.col("least") - F.col("x.d")))
    summed = long.groupBy(row_id, F.col("x.label").alias("label")).agg(weight.alias("w"))
    totals = long.groupBy(row_id).agg(weight.alias("all"))
    return summed.join(totals, row_id).select(row_id, "label", (F.col("w") / F.col("all")).alias("p"))


def knn_entropy(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", k: int = 10) -> DataFrame:
    """``(row_id, score)``: entropy of the labels of the k nearest rows, own row included."""
    classes = neighbour_classes(nearest_neighbours(df, row_id, vector, label, k), row_id)
    return classes.groupBy(row_id).agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("score"))


def knn_flagger(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", k: int = 10) -> DataFrame:
    """``(row_id, flag, corrected)``: the label isn't the likeliest of the k nearest rows, ties to the lowest."""
    near = nearest_neighbours(df, row_id, vector, label, k)
    classes = neighbour_classes(near, row_id).select(row_id, F.col("label").alias("corrected"), F.round("p", 9).alias("p"))
    top = classes.groupBy(row_id).agg(F.max("p").alias("top"))
    best = classes.join(top, row_id).where("p = top").groupBy(row_id).agg(F.min("corrected").alias("corrected"))
    return near.join(best, row_id).select(row_id, (F.col(label) != F.col("corrected")).alias("flag"), "corrected")


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``(label, centroid)``: the mean vector of each label."""
    sums = vector_sums(df.where(F.col(vector).isNotNull()), vector, label)
    return sums.select(label, F.transform("sums", lambda x: x / F.col("n")).alias("centroid"))


def mean_distance(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", metric: str | None = "euclidean", k: int = 20) -> DataFrame:
    """``(row_id, score)``: distance of each row to the mean vector of its label.

    ``metric`` is ``euclidean`` (or None), ``cosine``, ``dot`` (negated product) or ``lof``,
    the local outlier factor among the rows of the label. Zero vectors have a null cosine.
    """
    if metric == "lof":
        return local_outlier_factor(df, row_id, vector, label, k)
    if metric not in (None, "euclidean", "cosine", "dot"):
        raise ValueError(f"no such metric: {metric}")
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(row_id, label, vector)
    joined = skew_join(rows, centroids(rows, vector, label), label, right_unique=True)
    v, c = F.col(vector), F.col("centroid")
    product = arrays.array_sum(F.zip_with(v, c, lambda x, y: x.cast("double") * y))
    norm = lambda a: F.sqrt(arrays.array_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    score = {
        "cosine": lambda: 1 - F.try_divide(product, norm(v) * norm(c)),
        "dot": lambda: -product,
    }.get(metric, lambda: F.sqrt(arrays.squared_distance(v, c)))()
    return joined.select(row_id, score.alias("score"))


def local_outlier_factor(df: DataFrame, row_id: str, vector: str, label: str, k: int = 20) -> DataFrame:
    """``(row_id, score)``: the local outlier factor within each label; 1 for a label of one row."""
    near = checkpoint(nearest_neighbours(df, row_id, vector, label, k, same_label=True, without_self=True))
    reach_of = near.select(F.col(row_id).alias("other"), F.sqrt(F.array_max(F.col("near")["d"])).alias("kd"))
    pairs = near.select(row_id, F.explode("near").alias("x")).select(row_id, F.col("x.id").alias("other"), F.sqrt("x.d").alias("d"))
    reach = pairs.join(reach_of, "other").groupBy(row_id).agg(F.avg(F.greatest("d", "kd")).alias("mean"))
    density = reach.select(row_id, (1 / (F.col("mean") + 1e-10)).alias("density"))
    others = density.select(F.col(row_id).alias("other"), F.col("density").alias("theirs"))
    ratio = pairs.join(others, "other").groupBy(row_id).agg(F.avg("theirs").alias("theirs")).join(density, row_id)
    factor = ratio.select(row_id, (F.col("theirs") / F.col("density")).alias("factor"))
    return near.select(row_id).join(factor, row_id, "left").select(row_id, F.coalesce("factor", F.lit(1.0)).alias("score"))


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, rate: float = 1.0, penalty: float = 1e-3) -> np.ndarray:
    """Weights, with the bias in the last row, of multinomial logistic regression by accelerated descent."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    target = np.eye(classes)[y]
    weights = ahead = np.zeros((x.shape[1], classes))
    step = rate / max(0.5 * np.linalg.norm(x, 2) ** 2 / max(len(x), 1) + penalty, 1e-9)
    for n in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (x.T @ (p - target) / max(len(x), 1) + penalty * ahead)
        weights, ahead = new, new + n / (n + 3) * (new - weights)
    return weights


def projection_ensemble(
    train: DataFrame,
    evaluate: DataFrame,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    dims: tuple[int, ...] = (32, 64, 128, 256),
    seeds: tuple[int, ...] = (1, 2, 3, 4),
    max_train_rows: int = MAX_TRAIN_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Votes of logistic regressions on random projections: ``(flags, votes)``.

    One model for each dimension and seed, and one without projection, each fitted by its
    own task on at most ``max_train_rows`` training rows, those of the smallest id hashes.
    All rows of ``evaluate`` are predicted in one pass. ``flags`` is ``(row_id, flag,
    corrected)``, ties of the vote to the smallest label; ``votes`` is ``(row_id, model,
    prediction)``.
    """
    spark = train.sparkSession
    usable = train.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    sample = usable.select(F.col(vector).alias("v"), F.col(label).cast("string").alias("y"), F.xxhash64(row_id).alias("h"))
    frame = sample.orderBy("h").limit(max_train_rows).toPandas()
    names = sorted(frame["y"].unique())
    x, y = _matrix(frame["v"]), frame["y"].map({n: k for k, n in enumerate(names)}).to_numpy(int)
    shared = spark.sparkContext.broadcast((x, y))
    settings = [(0, 0, 0), *((1 + k, d, s) for k, (d, s) in enumerate((d, s) for d in dims for s in seeds))]

    def projection(dim: int, seed: int, width: int) -> np.ndarray:
        return np.eye(width) if not dim else np.random.default_rng((seed, dim)).normal(0, 1 / np.sqrt(dim), (width, dim))

    def fit(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for model, dim, seed in frame.itertuples(index=False):
                x, y = shared.value
                own = projection(dim, seed, x.shape[1])
                weights = fit_softmax(x @ own, y, len(names))
                yield pd.DataFrame({"model": [model], "weights": [np.concatenate([own @ weights[:-1], weights[-1:]]).ravel().tolist()]})

    plan = spark.createDataFrame(settings, "model int, dim int, seed int").repartition(len(settings), "model")
    weights = np.stack([np.array(r.weights).reshape(-1, len(names)) for r in plan.mapInPandas(fit, "model int, weights array<double>").orderBy("model").collect()])
    fitted = spark.sparkContext.broadcast(weights)

    def predict(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            v = _matrix(frame["v"])
            v = np.concatenate([v, np.ones((len(v), 1))], axis=1)
            best = np.stack([np.round(v @ w, 9).argmax(axis=1) for w in fitted.value], axis=1)
            votes = np.stack([(best == k).sum(axis=1) for k in range(len(names))], axis=1)
            yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "best": [[names[k] for k in b] for b in best], "vote": [names[k] for k in votes.argmax(axis=1)]})

    rows = evaluate.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("id"), F.col(label).cast("string").alias("y"), F.col(vector).alias("v"))
    schema = T.StructType([rows.schema["id"], T.StructField("y", T.StringType()), T.StructField("best", T.ArrayType(T.StringType())), T.StructField("vote", T.StringType())])
    predicted = rows.mapInPandas(predict, schema)
    flags = predicted.select(F.col("id").alias(row_id), (F.col("y") != F.col("vote")).alias("flag"), F.col("vote").alias("corrected"))
    votes = predicted.select(F.col("id").alias(row_id), F.posexplode("best").alias("model", "prediction"))
    return flags, votes
