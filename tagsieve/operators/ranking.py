"""Exact ranks over whole tables without a one-task window.

Rows are range-partitioned by group and order and sorted there, which is the only shuffle;
their places within the partition are then shifted by the rows of the group in earlier
partitions. The sorted rows are checkpointed, as a row's place must be the same in both uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.plans.runtime import checkpoint, shuffle_width

#: Groups and partitions whose shifts are broadcast; more are joined by a shuffle.
MAX_SHIFTS = 1_000_000
#: Bits that a row's place within its partition takes in its increasing id.
PLACE_BITS = 33


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", group: list[str] | None = None) -> DataFrame:
    """``df`` with the row's place from 1, within its ``group``, in ``order``, which must be total.

    ``order`` must tell any two rows apart, or ranks of equal rows are exchangeable. A group
    of a third of all rows spreads over a third of the partitions.
    """
    group = group or []
    keys = [F.col(f"`{g}`") for g in group] + order
    sorted_rows = df.repartitionByRange(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = checkpoint(sorted_rows.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", PLACE_BITS).alias("__part")
    sizes = placed.groupBy(*group, part).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    if group:
        shifts = checkpoint(shifts)
    same = F.shiftright("l.__place", PLACE_BITS) == F.col("s.__part")
    for g in group:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"s.{g}"))
    few = not group or shifts.limit(MAX_SHIFTS + 1).count() <= MAX_SHIFTS
    joined = placed.alias("l").join((F.broadcast(shifts) if few else shifts).alias("s"), same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l.__place") + F.col("s.__shift")).cast("long").alias(name))
