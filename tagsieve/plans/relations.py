"""The relations that operators read, their checks, and the small facts about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsieve.operators.ranking import global_rank

#: Columns and types of each relation; further columns are allowed and ignored.
SCHEMAS = {
    "instances": {"id": T.LongType(), "text": T.StringType(), "noisy": T.StringType()},
    "tokens": {"sent_id": T.LongType(), "pos": T.IntegerType(), "token": T.StringType(), "noisy": T.StringType()},
    "preds": {"id": T.LongType(), "model": T.IntegerType(), "fold": T.IntegerType(), "prediction": T.StringType()},
    "probs": {"id": T.LongType(), "probs": T.ArrayType(T.DoubleType())},
    "rep_probs": {"id": T.LongType(), "t": T.IntegerType(), "probs": T.ArrayType(T.DoubleType())},
    "vectors": {"id": T.LongType(), "vec": T.ArrayType(T.FloatType()), "noisy": T.StringType()},
    "train_log": {"epoch": T.IntegerType(), "id": T.LongType(), "prediction": T.StringType(), "loss": T.DoubleType(), "probs": T.ArrayType(T.DoubleType())},
}


def check(df: DataFrame, relation: str) -> DataFrame:
    """``df`` if it has the columns of the relation with types of the same kind; an error otherwise."""
    for name, kind in SCHEMAS[relation].items():
        if name not in df.columns:
            raise ValueError(f"{relation} needs a column {name}")
        own = df.schema[name].dataType
        integral = (T.LongType, T.IntegerType, T.ShortType)
        if type(own) is not type(kind) and not (isinstance(own, integral) and isinstance(kind, integral)):
            raise ValueError(f"{relation}.{name} should be {kind.simpleString()}, not {own.simpleString()}")
    return df


def summary(df: DataFrame, label: str = "noisy") -> DataFrame:
    """``(instances, labels)``: rows and distinct labels, null being none."""
    return df.agg(F.count("*").alias("instances"), F.countDistinct(label).alias("labels"))


def tag_set(df: DataFrame, label: str = "noisy") -> DataFrame:
    return df.where(F.col(label).isNotNull()).select(label).distinct()


def error_flags(df: DataFrame, row_id: str = "id") -> DataFrame:
    """``(row_id, is_error)``: whether gold and noisy label differ; null if either is."""
    return df.select(row_id, (F.col("gold") != F.col("noisy")).alias("is_error"))


def label_encoder(df: DataFrame, label: str = "noisy") -> DataFrame:
    """``(idx, label)``: the distinct labels in order, numbered from 0 by ranks over all partitions, however many there are."""
    ranked = global_rank(tag_set(df, label), [F.col(label)], "place")
    return ranked.select((F.col("place") - 1).cast("int").alias("idx"), F.col(label).alias("label"))


def subset(df: DataFrame, n: int, row_id: str = "id") -> DataFrame:
    """The n rows of the smallest ids; an error if there are fewer."""
    if n < 0 or df.limit(n).count() < n:
        raise IndexError(f"there are fewer than {n} rows")
    return df.orderBy(row_id).limit(n)
