"""Label noise that is the same for any partitioning, and the random baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.arrays import hash_unit


def _indexed(df: DataFrame, row_id: str, label: str, classes: DataFrame) -> DataFrame:
    known = F.broadcast(classes.select("idx", F.col("label").alias(label)))
    return df.select(row_id, label).join(known, label, "left").crossJoin(F.broadcast(classes.agg(F.count("*").alias("c"))))


def _named(rows: DataFrame, row_id: str, label: str, classes: DataFrame) -> DataFrame:
    named = F.broadcast(classes.select(F.col("idx").alias("to"), F.col("label").alias("drawn")))
    return rows.join(named, "to", "left").select(row_id, F.when(F.col("idx").isNull(), F.col(label)).otherwise(F.col("drawn")).alias("noisy"))


def flipped_label_noise(df: DataFrame, row_id: str, label: str, classes: DataFrame, p: float, seed: int = 42) -> DataFrame:
    """``(row_id, noisy)``: with probability p one of the other labels, each alike.

    ``classes`` is ``(idx, label)`` with indexes from 0. Labels outside it stay as they are,
    and so do all with a single class.
    """
    rows = _indexed(df, row_id, label, classes)
    flips = hash_unit(seed, F.col(row_id)) < p
    offset = 1 + F.floor(hash_unit(seed + 1, F.col(row_id)) * (F.col("c") - 1))
    to = F.when(flips & (F.col("c") > 1), F.pmod(F.col("idx") + offset, F.col("c"))).otherwise(F.col("idx"))
    return _named(rows.withColumn("to", to), row_id, label, classes)


def uniform_label_noise(df: DataFrame, row_id: str, label: str, classes: DataFrame, p: float, seed: int = 42) -> DataFrame:
    """``(row_id, noisy)``: with probability p a label drawn from all, its own included."""
    rows = _indexed(df, row_id, label, classes)
    draws = hash_unit(seed, F.col(row_id)) < p
    to = F.when(draws & F.col("idx").isNotNull(), F.floor(hash_unit(seed + 1, F.col(row_id)) * F.col("c"))).otherwise(F.col("idx"))
    return _named(rows.withColumn("to", to), row_id, label, classes)


def random_scores(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    return df.select(row_id, hash_unit(seed, F.col(row_id)).alias("score"))


def random_flags(df: DataFrame, row_id: str, p: float = 0.5, seed: int = 42) -> DataFrame:
    return df.select(row_id, (hash_unit(seed, F.col(row_id)) < p).alias("flag"))
