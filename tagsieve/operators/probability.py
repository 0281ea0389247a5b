"""Detectors from predictions and class probabilities.

Probability rows are arrays in the order of a class table ``(idx, label)``. Rows with a null
label, prediction or probability array get a null flag or score; labels outside the class
table have no probability and a null score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.functions import arrays
from tagsieve.operators.ranking import global_rank


def retag(df: DataFrame, row_id: str, label: str, prediction: str) -> DataFrame:
    """``(row_id, flag, corrected)``: rows whose label isn't the predicted one."""
    return df.select(row_id, (F.col(label) != F.col(prediction)).alias("flag"), F.col(prediction).alias("corrected"))


def classification_entropy(probs: DataFrame, row_id: str = "id") -> DataFrame:
    """``(row_id, score)``: the entropy, in nats, of each probability row scaled to sum 1."""
    return probs.select(row_id, arrays.entropy(F.col("probs")).alias("score"))


def with_label_index(df: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """``df`` with the class index ``idx`` of its label; the class table is one row a label."""
    return df.join(F.broadcast(classes.select("idx", F.col("label").alias(label))), label, "left")


def classification_uncertainty(df: DataFrame, classes: DataFrame, row_id: str = "id", label: str = "noisy") -> DataFrame:
    """``(row_id, score)``: one less the probability of the given label; ``df`` has ``probs``."""
    return with_label_index(df.select(row_id, label, "probs"), classes, label).select(row_id, (1 - F.get("probs", F.col("idx"))).alias("score"))


def prediction_margin(probs: DataFrame, row_id: str = "id") -> DataFrame:
    """``(row_id, score)``: one less the gap of the two largest probabilities; null with one class."""
    return probs.select(row_id, (1 - arrays.top_two_gap(F.col("probs"))).alias("score"))


def dropout_uncertainty(rep: DataFrame, row_id: str = "id", formulation: str = "entropy", classes: int | None = None) -> DataFrame:
    """``(row_id, score)`` from repeated probability rows ``(row_id, t, probs)``.

    ``entropy``: the entropy of the mean row, not rescaled. ``original``: the mean squared
    norm less the squared norm of the mean. ``variance``: the variance of the best class.
    ``classes`` is the length of the rows, which else is looked up first.
    """
    if formulation == "variance":
        return rep.groupBy(row_id).agg(F.var_pop(arrays.arg_max(F.col("probs")).cast("double")).alias("score"))
    if formulation not in ("entropy", "original"):
        raise ValueError(f"no such formulation: {formulation}")
    width = classes or rep.agg(F.max(F.size("probs"))).first()[0] or 0
    # one average a class, so that a row's turns combine before its few sums are shuffled
    cells = [F.get("probs", F.lit(c)) for c in range(width)]
    means = [F.avg(p).alias(f"m{c}") for c, p in enumerate(cells)]
    squares = [F.avg(p * p).alias(f"s{c}") for c, p in enumerate(cells)] if formulation == "original" else []
    rows = rep.groupBy(row_id).agg(*means, *squares) if width else rep.select(row_id).distinct()
    score = F.lit(0.0)
    for c in range(width):
        m = F.col(f"m{c}")
        term = F.col(f"s{c}") - m * m if squares else F.when(m > 0, -m * F.ln(m)).otherwise(0.0)
        score = score + F.coalesce(term, F.lit(0.0))
    return rows.select(row_id, score.alias("score"))


def confident_learning(df: DataFrame, classes: DataFrame, row_id: str = "id", label: str = "noisy") -> DataFrame:
    """``(row_id, flag)``: label issues by confident learning, pruned by noise rate.

    Classes that no row is labelled with are dropped without rescaling. A class's threshold
    is the mean of its probability over the rows labelled with it; a row counts for its most
    probable class at or above the threshold (ties: first class). The counts, scaled to the
    label counts, say how many rows of each pair of label and class to flag: those with the
    largest margin, ties by ``row_id``. Only tables of classes are broadcast; the ranks of a
    label of most rows are taken across partitions.
    """
    rows = with_label_index(df.select(row_id, label, "probs"), classes, label)
    known = rows.where("idx is not null and probs is not null").select(row_id, F.col("idx").alias("s"), "probs")
    own = known.groupBy("s").agg(F.avg(F.get("probs", F.col("s"))).alias("t"), F.count("*").alias("n"))
    limits = F.broadcast(own.agg(F.map_from_entries(F.collect_list(F.struct("s", F.round("t", 9).alias("t")))).alias("limits")))

    def candidate(p, j):
        limit = F.col("limits")[j.cast("int")]
        return F.when(limit.isNotNull() & (F.round(p, 9) >= limit), F.struct(p.alias("p"), (-j).alias("j")))

    top = F.array_max(F.array_compact(F.transform("probs", candidate)))
    best = known.crossJoin(limits).select("s", (-top["j"]).alias("j")).where("j is not null")
    joint = best.groupBy("s", "j").agg(F.count("*").alias("c"))
    counted = joint.join(F.broadcast(own.select("s", "n")), "s").withColumn("row", F.sum("c").over(Window.partitionBy("s")))
    quota = counted.where("s <> j").select("s", "j", F.floor(F.col("c") * F.col("n") / F.col("row") + 0.5).alias("quota"))
    wanted = F.broadcast(quota.where("quota > 0"))
    margin = F.round(F.get("probs", F.col("j")) - F.get("probs", F.col("s")), 9)
    margins = known.join(wanted, "s").select(row_id, "s", "j", margin.alias("margin"), "quota")
    ranked = global_rank(margins, [F.col("margin").desc(), F.col(row_id)], "place", ["s", "j"])
    issues = ranked.where("place <= quota").select(row_id).distinct().withColumn("issue", F.lit(True))
    valid = F.when(F.col("idx").isNotNull() & F.col("probs").isNotNull(), F.coalesce("issue", F.lit(False)))
    return rows.join(issues, row_id, "left").select(row_id, valid.alias("flag"))
