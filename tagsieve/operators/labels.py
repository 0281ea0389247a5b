"""Detectors from the labels of a surface form alone.

Forms are compared as given, so callers lower-case them first. Null labels and null forms
are no observation: their rows come out with a null flag, score and correction. Ties go to
the label first seen by ``row_id``. Statistics per form join back to the rows with the join
for heavy keys, since a handful of forms may hold most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.arrays import min_max
from tagsieve.operators.skew import skew_join
from tagsieve.plans.runtime import checkpoint

HEAVY_SHARE = 0.01


def majority_label(df: DataFrame, row_id: str, label: str) -> DataFrame:
    """``(row_id, flag, corrected)``: rows whose label isn't the most frequent of all."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.min(row_id).alias("first"))
    mode = counts.agg(F.max_by(F.col(label), F.struct(F.col("n"), -F.col("first"))).alias("corrected"))
    flagged = df.select(row_id, label).crossJoin(F.broadcast(mode))
    return flagged.select(row_id, (F.col(label) != F.col("corrected")).alias("flag"), "corrected")


def form_stats(df: DataFrame, row_id: str, form: str, label: str) -> DataFrame:
    """Per form: ``n`` rows, ``k`` labels, most and least rows of a label, entropy in bits, majority."""
    seen = df.where(F.col(form).isNotNull() & F.col(label).isNotNull())
    counts = seen.groupBy(form, label).agg(F.count("*").alias("c"), F.min(row_id).alias("first"))
    total = F.sum("c")
    # the entropy of counts c with sum n is log2(n) - sum(c log2 c) / n, which needs one pass
    bits = F.log2(total.cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / total
    return counts.groupBy(form).agg(
        total.alias("n"),
        F.count("*").alias("k"),
        F.max("c").alias("most"),
        F.min("c").alias("least"),
        bits.alias("bits"),
        F.max_by(F.col(label), F.struct(F.col("c"), -F.col("first"))).alias("majority"),
    )


def with_form_stats(df: DataFrame, row_id: str, form: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the statistics of their form, and the statistics, which are computed and kept once.

    Exact counts name the heavy forms here, so no sketch is needed.
    """
    rows = df.select(row_id, form, label)
    stats = checkpoint(form_stats(rows, row_id, form, label))
    total = F.broadcast(stats.agg(F.sum("n").alias("total")))
    heavy = stats.crossJoin(total).where(F.col("n") >= HEAVY_SHARE * F.col("total"))
    return skew_join(rows, stats, form, "left", heavy=heavy, right_unique=True), stats


def majority_per_form(df: DataFrame, row_id: str, form: str, label: str) -> DataFrame:
    """``(row_id, flag, corrected)``: rows whose label isn't the most frequent of their form."""
    rows, _ = with_form_stats(df, row_id, form, label)
    return rows.select(row_id, (F.col(label) != F.col("majority")).alias("flag"), F.col("majority").alias("corrected"))


def _scaled(rows: DataFrame, stats: DataFrame, row_id: str, label: str, plain: float, odd: Column, score) -> DataFrame:
    """Min-max scaled raw scores: ``plain`` for rows of the majority or only label, ``odd`` for others.

    Every form has a row of its majority, and one of several labels a row of another, so
    the least and largest raw score follow from the statistics alone.
    """
    several = F.when(F.col("k") > 1, odd)
    ends = stats.agg(F.least(F.min(several), F.lit(plain)).alias("low"), F.greatest(F.max(several), F.lit(plain)).alias("high"))
    raw = F.when(F.col(label).isNull() | F.col("k").isNull(), None).when((F.col("k") < 2) | (F.col(label) == F.col("majority")), plain).otherwise(odd)
    return rows.crossJoin(F.broadcast(ends)).select(row_id, score(min_max(raw, F.col("low"), F.col("high"))).alias("score"))


def label_entropy(df: DataFrame, row_id: str, form: str, label: str, majority_zero: bool = False) -> DataFrame:
    """``(row_id, score)``: one less the min-max scaled entropy of the form's labels.

    Rows of the majority label, and of forms with one label, have the raw entropy 1, as the
    original method does, so they may score highest; ``majority_zero`` gives them raw 0 and
    the scaled entropy itself as the score instead, the documented intent.
    """
    rows, stats = with_form_stats(df, row_id, form, label)
    score = (lambda x: x) if majority_zero else (lambda x: 1 - x)
    return _scaled(rows, stats, row_id, label, 0.0 if majority_zero else 1.0, F.col("bits"), score)


def weighted_discrepancy(df: DataFrame, row_id: str, form: str, label: str) -> DataFrame:
    """``(row_id, score)``: min-max scaled ``(most - least) / k * n`` of the form, 0 for its majority label."""
    rows, stats = with_form_stats(df, row_id, form, label)
    odd = (F.col("most") - F.col("least")) / F.col("k") * F.col("n")
    return _scaled(rows, stats, row_id, label, 0.0, odd, lambda x: x)
