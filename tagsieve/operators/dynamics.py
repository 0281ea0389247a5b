"""Detectors from the course of a training: data maps, curriculum and Leitner spotting.

The model is softmax regression over vectors, trained by full-batch steps whose gradients
are summed across partitions. What a row was at an epoch, its loss, correctness and queue,
follows from the weights of the epochs and a few numbers for each: every epoch is one pass
over the rows with the weights since the state of the rows was last written, if it ever was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.operators.ranking import global_rank
from tagsieve.plans.runtime import stored

#: Bins of losses that are counted at a time, and rows that are sorted on the driver.
BINS, MAX_SORTED = 1024, 10_000
#: Epochs after which the state of every row is written.
KEEP_EVERY = 8


def datamap_confidence(log: DataFrame, row_id: str = "id") -> DataFrame:
    """``(row_id, score)`` from ``(epoch, row_id, idx, probs)``: one less the mean probability of the given class."""
    return log.groupBy(row_id).agg((1 - F.avg(F.get("probs", F.col("idx")))).alias("score"))


class SoftmaxTraining:
    """Epochs of softmax regression on ``(id, y, v)`` with class numbers ``y`` from 0."""

    def __init__(self, df: DataFrame, row_id: str, vector: str, label: str, rate: float = 4.0):
        usable = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
        self.names = [r[0] for r in usable.select(F.col(label).cast("string")).distinct().orderBy(label).collect()]
        order = F.array(*[F.lit(n) for n in self.names]) if self.names else F.array().cast("array<string>")
        index = (F.array_position(order, F.col(label).cast("string")) - 1).cast("int")
        self.rows = usable.select(F.col(row_id).cast("long").alias("id"), index.alias("y"), F.col(vector).alias("v"))
        first = self.rows.select(F.size("v")).first()
        self.width, self.classes, self.rate = (first[0] + 1 if first else 1), len(self.names), rate

    @staticmethod
    def predict(weights: list[np.ndarray], frame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors with bias, probabilities by epoch, losses by epoch and correctness by epoch of a batch."""
        v = np.stack([np.asarray(x, np.float64) for x in frame["v"]])
        v = np.concatenate([v, np.ones((len(v), 1))], axis=1)
        z = np.einsum("nd,edc->enc", v, np.stack(weights))
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        y = frame["y"].to_numpy()
        loss = np.round(-np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-12)), 9)
        return v, p, loss, np.round(p, 9).argmax(axis=2) == y[None, :]

    def step(self, weights: np.ndarray, chosen: Callable[[object], np.ndarray]) -> np.ndarray:
        """Weights after one step on the rows that ``chosen`` (batch -> mask) picks."""
        shared = self.rows.sparkSession.sparkContext.broadcast(weights)
        width, classes, predict = self.width, self.classes, self.predict

        def gradient(frames: Iterator) -> Iterator:
            import pandas as pd

            total, n = np.zeros((width, classes)), 0
            for frame in frames:
                if len(frame):
                    mask = chosen(frame)
                    v, p, _, _ = predict([shared.value], frame)
                    total += v[mask].T @ (p[0] - np.eye(classes)[frame["y"].to_numpy()])[mask]
                    n += int(mask.sum())
            yield pd.DataFrame({"at": np.arange(total.size + 1), "x": np.append(total.ravel(), n)})

        sums = self.rows.mapInPandas(gradient, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros(width * classes + 1)
        flat[sums["at"].to_numpy()] = sums["x"].to_numpy()
        return self.moved(weights, flat[:-1].reshape(width, classes), flat[-1])

    def moved(self, weights: np.ndarray, gradient: np.ndarray, rows: float) -> np.ndarray:
        """Weights after a step along the gradient summed over so many rows."""
        return weights - self.rate * gradient / max(rows, 1)

    def start(self) -> np.ndarray:
        return np.zeros((self.width, self.classes))

    def log(self, weights: list[np.ndarray]) -> DataFrame:
        """``(epoch, id, idx, prediction, loss, probs)`` of every row at every epoch."""
        shared = self.rows.sparkSession.sparkContext.broadcast(weights)
        predict = self.predict

        def run(frames: Iterator) -> Iterator:
            import pandas as pd

            for frame in frames:
                if not len(frame):
                    continue
                _, p, loss, _ = predict(shared.value, frame)
                for epoch in range(len(shared.value)):
                    best = np.round(p[epoch], 9).argmax(axis=1)
                    yield pd.DataFrame({"epoch": epoch, "id": frame["id"], "idx": frame["y"], "prediction": best, "loss": loss[epoch], "probs": list(p[epoch])})

        return self.rows.mapInPandas(run, "epoch int, id long, idx int, prediction int, loss double, probs array<double>")

    def final(self, run: Callable, schema: str) -> DataFrame:
        """One last pass: ``run`` (batch -> pandas frame) over all rows."""

        def each(frames: Iterator) -> Iterator:
            for frame in frames:
                if len(frame):
                    yield run(frame)

        return self.rows.mapInPandas(each, schema)


def train_log(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", epochs: int = 24) -> DataFrame:
    """The log of a training on all rows, for the data map."""
    training = SoftmaxTraining(df, row_id, vector, label)
    weights = [training.start()]
    for _ in range(epochs):
        weights.append(training.step(weights[-1], lambda frame: np.ones(len(frame), bool)))
    return training.log(weights[1:])


def smallest(rows: DataFrame, k: int) -> tuple[float, int, int]:
    """``(loss, id, n)``: the last of the k smallest rows ``(loss, id)`` in order of loss and id, and their number.

    Counts by bins of the loss narrow the place down, so that no row is sorted or shuffled
    but the few in the last bin; where equal losses fill it they are ranked.
    """
    whole = rows.agg(F.count("*").alias("n"), F.min("loss").alias("low"), F.max("loss").alias("high")).first()
    k = min(k, whole.n)
    if not k:
        return -np.inf, -1, 0
    low, high, count, before = whole.low, whole.high, whole.n, 0
    while count > MAX_SORTED and high > low:
        bin_of = F.least(F.floor((F.col("loss") - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1)).alias("bin")
        within = rows.where(F.col("loss").between(F.lit(low), F.lit(high))).groupBy(bin_of)
        for row in sorted(within.agg(F.count("*").alias("n"), F.min("loss").alias("low"), F.max("loss").alias("high")).collect(), key=lambda r: r.bin):
            if before + row.n >= k:
                break
            before += row.n
        if row.n == count:
            break
        low, high, count = row.low, row.high, row.n
    last = rows.where(F.col("loss").between(F.lit(low), F.lit(high))).select("loss", "id")
    if count > MAX_SORTED:
        cut = global_rank(last, [F.col("loss"), F.col("id")], "place").where(F.col("place") == k - before).first()
        return cut.loss, cut.id, k
    return (*sorted(map(tuple, last.collect()))[k - before - 1], k)


def curriculum_spotter(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", epochs: int = 24) -> DataFrame:
    """``(row_id, score)``: summed loss of the rows picked as the hard part of each epoch.

    At each epoch rows with at most the mean loss of the right ones are easy; of the others
    the ``int(n * epoch / epochs)`` of the smallest loss are hard, and the next epoch trains
    on both. A hard row gains its loss and one by their number. Rows never hard score their
    final loss. Without any right row none is easy, and an epoch without hard rows adds 0.
    """
    training = SoftmaxTraining(df, row_id, vector, label)
    n = training.rows.count()
    weights, rules = [training.start()], []
    predict = training.predict

    def parts(frame, weight: np.ndarray, rule: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, loss_cut, id_cut, _ = rule
        _, _, loss, _ = predict([weight], frame)
        easy = loss[0] <= mean
        hard = ~easy & ((loss[0] < loss_cut) | ((loss[0] == loss_cut) & (frame["id"].to_numpy() <= id_cut)))
        return loss[0], easy, hard

    for epoch in range(1, epochs + 1):
        if rules:
            last = weights[-1], rules[-1]

            def chosen(frame, last=last):
                _, easy, hard = parts(frame, *last)
                return easy | hard

        else:

            def chosen(frame):
                return np.ones(len(frame), bool)

        weights.append(training.step(weights[-1], chosen))
        log = stored(training.log([weights[-1]]).select("id", "loss", (F.col("prediction") == F.col("idx")).alias("hit")))
        mean = log.where("hit").agg(F.avg("loss")).first()[0]
        mean = -np.inf if mean is None else mean
        rules.append((mean, *smallest(log.where(F.col("loss") > F.lit(float(mean))), int(n * epoch / epochs))))

    def score(frame):
        import pandas as pd

        total = np.zeros(len(frame))
        for weight, rule in zip(weights[1:], rules):
            loss, _, hard = parts(frame, weight, rule)
            total += np.where(hard, loss + (1 / rule[3] if rule[3] else 0), 0)
        return pd.DataFrame({"id": frame["id"], "score": np.where(total == 0, loss, total)})

    return training.final(score, "id long, score double").withColumnRenamed("id", row_id)


def leitner_spotter(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", epochs: int = 48, queues: int = 5) -> DataFrame:
    """``(row_id, score)``: summed loss, and one by the queue's size, while in the first queue.

    All rows begin in queue 0. Queue q is trained when the epoch is a multiple of 2^q; a
    trained row that the model then gets right moves up a queue, to the last at most, a
    wrong one back to the first, and untrained rows stay. Rows that score nothing take
    their final loss.
    """
    training = SoftmaxTraining(df, row_id, vector, label)
    weights, sizes, predict, width, classes = [training.start()], [], training.predict, training.width, training.classes
    # queue, score so far and last loss of every row are kept every few epochs, so that a pass replays only those since
    state, since = training.rows.select("*", F.lit(0).alias("queue"), F.lit(0.0).alias("total"), F.lit(0.0).alias("loss")), 0

    def replayed(frame, since: int, known: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queues, scores and losses after the epochs known; the score of an epoch whose first queue isn't counted yet is left out."""
        queue, total, loss = (frame[c].to_numpy() for c in ("queue", "total", "loss"))
        if known:
            _, _, losses, right = predict(known, frame)
            for k in range(len(known)):
                trained = (since + k) % (1 << queue) == 0
                queue = np.where(trained, np.where(right[k], np.minimum(queue + 1, queues - 1), 0), queue)
                loss = losses[k]
                if k < len(sizes):
                    total = total + np.where(queue == 0, loss + (1 / sizes[k] if sizes[k] else 0.0), 0)
        return queue, total, loss

    for epoch in range(epochs):
        if epoch - since == KEEP_EVERY:

            def kept(frames: Iterator, since=since, known=weights[since + 1 : epoch], sizes=sizes[since : epoch - 1]) -> Iterator:
                for frame in frames:
                    if len(frame):
                        queue, total, loss = replayed(frame, since, known, sizes)
                        yield frame.assign(queue=queue, total=total, loss=loss)

            state, since = stored(state.mapInPandas(kept, state.schema)), epoch - 1
        known, counted = weights[since + 1 :], sizes[since:]

        def sums(frames: Iterator, since=since, known=known, counted=counted, weight=weights[-1], epoch=epoch) -> Iterator:
            """The gradient over the rows that this epoch trains, their number and that of the first queue after the last epoch."""
            import pandas as pd

            total, n, first = np.zeros((width, classes)), 0, 0
            for frame in frames:
                if len(frame):
                    queue, _, _ = replayed(frame, since, known, counted)
                    mask = epoch % (1 << queue) == 0
                    v, p, _, _ = predict([weight], frame)
                    total += v[mask].T @ (p[0] - np.eye(classes)[frame["y"].to_numpy()])[mask]
                    n, first = n + int(mask.sum()), first + int((queue == 0).sum())
            yield pd.DataFrame({"at": np.arange(total.size + 2), "x": np.r_[total.ravel(), n, first]})

        added = state.mapInPandas(sums, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros(width * classes + 2)
        flat[added["at"].to_numpy()] = added["x"].to_numpy()
        if epoch:
            sizes.append(int(flat[-1]))
        weights.append(training.moved(weights[-1], flat[:-2].reshape(width, classes), flat[-2]))
    known, counted = weights[since + 1 :], sizes[since:]

    def last_size(frames: Iterator) -> Iterator:
        import pandas as pd

        yield pd.DataFrame({"n": [sum(int((replayed(f, since, known, counted)[0] == 0).sum()) for f in frames if len(f))]})

    if epochs:
        sizes.append(state.mapInPandas(last_size, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    counted = sizes[since:]

    def score(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            if len(frame):
                _, total, loss = replayed(frame, since, known, counted)
                yield pd.DataFrame({"id": frame["id"], "score": np.where(total == 0, loss, total)})

    return state.mapInPandas(score, "id long, score double").withColumnRenamed("id", row_id)
