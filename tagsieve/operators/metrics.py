"""Quality of flags, scores and probabilities against known errors, and calibration."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.functions import arrays
from tagsieve.operators.crossval import Callback
from tagsieve.operators.ranking import global_rank


def percentage_flagged(flags: DataFrame, flag: str = "flag") -> DataFrame:
    """``(share)``: flagged rows of all with a flag; null for none."""
    return flags.agg(F.avg(F.col(flag).cast("int")).alias("share"))


def flag_quality(df: DataFrame, flag: str = "flag", error: str = "is_error") -> DataFrame:
    """``(tp, fp, fn, tn, precision, recall, f1)`` of one row; undefined ratios are 0. Rows with a null are left out."""
    f, e = F.col(flag), F.col(error)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    sums = df.agg(count(f & e).alias("tp"), count(f & ~e).alias("fp"), count(~f & e).alias("fn"), count(~f & ~e).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return sums.select("tp", "fp", "fn", "tn", ratio("tp", tp + fp).alias("precision"), ratio("tp", tp + fn).alias("recall"), f1.alias("f1"))


def ranked_quality(df: DataFrame, row_id: str, score: str = "score", error: str = "is_error", share: float = 0.1) -> DataFrame:
    """``(average_precision, precision_at, recall_at)`` of rows by falling score, ties by ``row_id``.

    The cut at ``share`` takes the whole part of that share of all rows, at least one. The
    place of an error among the errors, and among all rows, come from ranks over all
    partitions. Rows with a null score are left out; without any error all are 0.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(error).isNotNull()).select(row_id, F.round(score, 9).alias("s"), F.col(error).alias("e"))
    placed = global_rank(rows, [F.col("s").desc(), F.col(row_id)], "place")
    hits = global_rank(placed.where("e").select(row_id, "place"), [F.col("place")], "hit")
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("e").cast("int")), F.lit(0)).alias("errors"))
    cut = F.greatest(F.floor(F.col("n") * share), F.lit(1))
    summed = hits.crossJoin(F.broadcast(totals)).agg(
        F.avg(F.col("hit") / F.col("place")).alias("ap"), F.sum(F.when(F.col("place") <= cut, 1).otherwise(0)).alias("found")
    )
    zero = F.lit(0.0)
    found = F.coalesce("found", F.lit(0))
    return totals.crossJoin(summed).select(
        F.coalesce("ap", zero).alias("average_precision"),
        F.coalesce(F.try_divide(found.cast("double"), cut), zero).alias("precision_at"),
        F.coalesce(F.try_divide(found.cast("double"), F.col("errors")), zero).alias("recall_at"),
    )


def expected_calibration_error(df: DataFrame, probs: str, correct_index: str, bins: int = 10) -> DataFrame:
    """``(ece)``: the mean gap of confidence and accuracy over equal bins of the confidence; 1.0 is in the last bin."""
    rows = df.where(F.col(probs).isNotNull() & F.col(correct_index).isNotNull())
    conf = F.array_max(probs)
    right = (arrays.arg_max(F.col(probs)) == F.col(correct_index)).cast("double")
    binned = rows.select(F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("bin"), conf.alias("conf"), right.alias("right"))
    per_bin = binned.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("right") - F.avg("conf")).alias("gap"))
    return per_bin.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def fit_temperatures(df: DataFrame, fold: str, probs: str, correct_index: str, low: float = 0.25, high: float = 4.0, steps: int = 33) -> DataFrame:
    """``(fold, temperature)`` of the least log loss among geometric steps, ties to the lowest.

    All temperatures are tried in one pass; per-fold sums of their losses are combined
    before they are shuffled.
    """
    grid = F.array(*[F.lit(low * (high / low) ** (s / (steps - 1))) for s in range(steps)])
    rows = df.where(F.col(probs).isNotNull() & F.col(correct_index).isNotNull())
    logs = F.transform(probs, lambda p: F.ln(F.greatest(p, F.lit(1e-6))))
    each = rows.select(fold, correct_index, logs.alias("z"), F.explode(grid).alias("temperature"))
    scaled = F.transform("z", lambda x: x / F.col("temperature"))
    loss = F.ln(arrays.array_sum(F.transform(scaled, lambda x: F.exp(x)))) - F.get(scaled, F.col(correct_index))
    losses = each.groupBy(fold, "temperature").agg(F.round(F.sum(loss), 6).alias("loss"))
    return losses.groupBy(fold).agg(F.min_by("temperature", F.struct("loss", "temperature")).alias("temperature"))


def calibrate(df: DataFrame, temperatures: DataFrame, fold: str, probs: str) -> DataFrame:
    """``df`` with ``calibrated``: its probabilities, or each repeated row, at its fold's temperature."""
    joined = df.join(F.broadcast(temperatures), fold, "left")
    temperature = F.coalesce("temperature", F.lit(1.0))
    raised = F.transform(probs, lambda p: F.exp(F.ln(F.greatest(p, F.lit(1e-6))) / temperature))
    return joined.withColumn("calibrated", arrays.unit_sum(raised)).drop("temperature")


def bin_shares(df: DataFrame, fold: str, probs: str, correct_index: str, bins: int = 20, isotonic: bool = False) -> DataFrame:
    """``(fold, shares)``: by class and equal bin of its probability, the share of rows of that class; null for an empty bin.

    With ``isotonic`` the shares are the best that don't fall from bin to bin: the least,
    over bins from there on, of the largest mean over bins up to there. Only folds,
    classes and bins make rows, so their lists are small.
    """
    rows = df.where(F.col(probs).isNotNull() & F.col(correct_index).isNotNull())
    long = rows.select(fold, F.posexplode(probs).alias("cls", "p"), correct_index)
    bin_of = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    counted = long.groupBy(fold, "cls", bin_of).agg(F.count("*").alias("n"), F.sum((F.col(correct_index) == F.col("cls")).cast("long")).alias("hits"))
    shares = counted.select(fold, "cls", "bin", (F.col("hits") / F.col("n")).alias("share"))
    if isotonic:
        keys = ["a." + fold, "a.cls"]
        same = (F.col(f"a.{fold}") == F.col(f"b.{fold}")) & (F.col("a.cls") == F.col("b.cls")) & (F.col("b.bin") >= F.col("a.bin"))
        upto = Window.partitionBy(*keys, "a.bin").orderBy("b.bin")
        blocks = counted.alias("a").join(counted.alias("b"), same).select(
            *keys, F.col("a.bin").alias("first"), F.col("b.bin").alias("last"), (F.sum("b.hits").over(upto) / F.sum("b.n").over(upto)).alias("mean")
        )
        least = blocks.withColumn("rest", F.min("mean").over(Window.partitionBy(fold, "cls", "first").orderBy(F.col("last").desc())))
        # for every bin: among blocks that begin at or before it, the largest of the least means of those that end at or after it
        by_bin = least.select(fold, "cls", F.col("last").alias("bin"), "rest")
        shares = by_bin.groupBy(fold, "cls", "bin").agg(F.max("rest").alias("share"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.struct("cls", "bin"), "share")))
    return shares.groupBy(fold).agg(entries.alias("shares"))


def calibrate_by_bins(df: DataFrame, shares: DataFrame, fold: str, probs: str, bins: int = 20) -> DataFrame:
    """``df`` with ``calibrated``: each probability replaced by its bin's share, scaled to sum 1; as it was where no share is known."""
    joined = df.join(F.broadcast(shares), fold, "left")
    at = lambda p, c: F.struct(c.alias("cls"), F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    raised = F.transform(probs, lambda p, c: F.coalesce(F.try_element_at("shares", at(p, c)), p))
    return joined.withColumn("calibrated", F.coalesce(arrays.unit_sum(raised), F.col(probs))).drop("shares")


#: The calibrations: how to fit on ``(df, fold, probs, correct index)``, and to apply on ``(df, fitted, fold, probs)``.
CALIBRATORS: dict[str, tuple[Callable, Callable]] = {
    "temperature": (fit_temperatures, calibrate),
    "histogram": (bin_shares, calibrate_by_bins),
    "isotonic": (partial(bin_shares, isotonic=True), calibrate_by_bins),
}


class CalibrationCallback(Callback):
    """Calibrates each fold's probabilities on its own holdout labels during a cross-validation.

    ``truth`` has ``(row_id, idx)`` with the class number of the holdout label. Predictions
    keep their columns and gain ``calibrated``; ``errors`` collects the fold's calibration
    error before and after. Works for flat and for token predictions, by the key columns.
    """

    def __init__(self, truth: DataFrame, keys: list[str], method: str = "temperature"):
        self.truth, self.keys = truth, keys
        self.fit, self.apply = CALIBRATORS[method]
        self.errors: list[tuple[int, float, float]] = []

    def on_after_predicting(self, fold: int, predicted: DataFrame) -> DataFrame:
        rows = predicted.join(self.truth.select(*self.keys, "idx"), self.keys).withColumn("__fold", F.lit(fold))
        fitted = self.fit(rows, "__fold", "probs", "idx")
        after = self.apply(rows, fitted, "__fold", "probs")
        before, calibrated = (expected_calibration_error(after, c, "idx").first().ece for c in ("probs", "calibrated"))
        self.errors.append((fold, before, calibrated))
        return self.apply(predicted.withColumn("__fold", F.lit(fold)), fitted, "__fold", "probs").drop("__fold")
