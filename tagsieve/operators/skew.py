"""Per-key results where a handful of keys hold most rows.

Heavy keys come from a mergeable frequent-items sketch of fixed size and are then counted
exactly. Joins send the rows of heavy keys through a broadcast join, which leaves them where
they are, and all other rows through an ordinary shuffle; the union of both is the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.plans.runtime import checkpoint

#: Items that the sketch tracks; its error is below 3.5 / 16384 of the rows at this size.
TRACKED = 10_000


def candidate_keys(df: DataFrame, key: str, share: float, tracked: int = TRACKED) -> DataFrame:
    """A superset, of at most ``4 / share`` rows, of the keys that hold ``share`` of the rows.

    The sketch never underestimates a key's upper bound, and at most ``1 / (share - error)``
    keys can reach ``share`` with theirs, so the bound holds for any input.
    """
    if not 8 / tracked <= share <= 1:
        raise ValueError(f"share must lie between {8 / tracked} and 1")
    k = min(tracked, 4 * math.ceil(1 / share))
    top = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {k}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key))


def heavy_keys(df: DataFrame, key: str, share: float, tracked: int = TRACKED) -> DataFrame:
    """``(key, n, total)`` of every key that holds at least ``share`` of all rows of ``df``.

    Null is no key, but rows with a null key count in ``total``. An empty table and a table
    of null keys have no heavy keys. Counts are exact: the sketch only names candidates.
    """
    candidates = F.broadcast(candidate_keys(df.select(key), key, share, tracked))
    counts = df.select(key).join(candidates, key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    # a quotient that equals the share is rounded as the share is; a product may not be
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") / F.col("total") >= F.lit(share))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    share: float = 0.005,
    heavy: DataFrame | None = None,
    right_unique: bool = False,
    max_broadcast_rows: int = 100_000,
    salts: int = 32,
) -> DataFrame:
    """Equi-join in which the rows of heavy keys of ``left`` are not shuffled by key.

    ``how`` is ``inner`` or ``left``. ``heavy`` may give the heavy keys (a frame of at most
    some thousand rows with the column ``key``); else they are found at ``share``. Their
    64-bit hashes, a few bytes each, come to the driver and stand in both filters as
    constants; a key that shares a hash only joins the broadcast side. With ``right_unique`` the
    heavy side of ``right`` has at most one row a key and is broadcast; otherwise it is
    counted first and, beyond ``max_broadcast_rows``, salted instead. Null keys match
    nothing: dropped by ``inner``, kept with nulls by ``left``. Columns of ``right`` that
    also occur in ``left`` must be renamed by the caller.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keys = candidate_keys(left.select(key), key, share) if heavy is None else heavy.select(key)
    marks = [r[0] for r in keys.where(F.col(key).isNotNull()).select(F.xxhash64(key)).distinct().collect()]
    if not marks:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key).isin(marks)), F.lit(False))
    hot, cold = left.where(is_hot), left.where(~is_hot)
    right_hot, right_cold = right.where(is_hot), right.where(~is_hot)
    if right_unique or right_hot.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        joined_hot = hot.join(F.broadcast(right_hot), key, how)
    else:
        spread = right_hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64(*[c for c, t in left.dtypes if not t.startswith(("map", "variant"))]), F.lit(salts))
        joined_hot = hot.withColumn("__salt", salt.cast("int")).join(spread, [key, "__salt"], how).drop("__salt")
    return cold.join(right_cold, key, how).unionByName(joined_hot)


def results_by_key(df: DataFrame, key: str, summarise: Callable[[DataFrame], DataFrame], share: float = 0.005) -> DataFrame:
    """``summarise`` of the rows of every key, computed apart for heavy and for other keys.

    ``summarise`` takes rows and gives results by key. Heavy keys are found by the sketch;
    their rows meet the few keys in a broadcast join and are summed up where they are
    before the sums are shuffled; the rows of all other keys go through an ordinary
    shuffle. Null is no key.
    """
    rows = df.where(F.col(key).isNotNull())
    heavy = checkpoint(candidate_keys(rows.select(key), key, share))
    return summarise(rows.join(F.broadcast(heavy), key, "left_semi")).unionByName(summarise(rows.join(F.broadcast(heavy), key, "left_anti")))


def majority_by_key(df: DataFrame, key: str, label: str, row_id: str, share: float = 0.005) -> DataFrame:
    """Every row of ``df`` with the most frequent label of its key: ``(row_id, key, label, majority, n)``.

    Ties go to the label first seen by ``row_id``. Null labels count as no label; a key
    without any label, and a null key, get a null majority and a null ``n``.
    """
    rows = df.select(row_id, key, label)
    pairs = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = pairs.groupBy(key, label).agg(F.count("*").alias("c"), F.min(row_id).alias("first"))
    best = counts.groupBy(key).agg(
        F.max_by(F.col(label), F.struct(F.col("c"), -F.col("first"))).alias("majority"), F.sum("c").alias("n")
    )
    return skew_join(rows, best, key, "left", share, right_unique=True)
