"""The stateless detectors over streams of predictions.

Retag, uncertainty, margin and entropy look at one row at a time, so they run unchanged on
a streaming frame. Deliveries may repeat; within the watermark of the run time each
``(id, model)`` counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(predictions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of ``(id, model, run_at, ...)`` without repeated deliveries of the same run."""
    return predictions.withWatermark("run_at", delay).dropDuplicatesWithinWatermark(["id", "model", "run_at"])


def retag_stream(predictions: DataFrame, instances: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``(id, model, run_at, flag, corrected)`` for every new prediction of a known instance."""
    joined = deduplicated(predictions, delay).join(instances.select("id", "noisy"), "id")
    return joined.select("id", "model", "run_at", (F.col("noisy") != F.col("prediction")).alias("flag"), F.col("prediction").alias("corrected"))


def disagreement_rates(flags: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``(begin_at, n, flagged)``: flags by windows of the run time; windows close after the delay."""
    timed = flags.withWatermark("run_at", delay) if flags.isStreaming else flags
    grouped = timed.groupBy(F.window("run_at", window).alias("w"))
    counts = grouped.agg(F.count("*").alias("n"), F.sum(F.when(F.col("flag"), 1).otherwise(0)).alias("flagged"))
    return counts.select(F.col("w.start").alias("begin_at"), "n", "flagged")
