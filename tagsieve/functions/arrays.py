"""Column functions over probability rows and other numeric arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def entropy(values: Column) -> Column:
    """Natural-log entropy of an array, normalised to sum 1 first; 0 log 0 is 0. Null for no mass."""

    def terms(total: Column) -> Column:
        return F.when(total > 0, array_sum(F.transform(values, lambda p: F.when(p > 0, -(p / total) * F.ln(p / total)).otherwise(0.0))))

    return let(array_sum(values), terms)


def raw_entropy(values: Column) -> Column:
    """Natural-log entropy of an array as it is; 0 log 0 is 0."""
    return array_sum(F.transform(values, lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0)))


def arg_max(values: Column) -> Column:
    """The index, from 0, of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_two_gap(values: Column) -> Column:
    """The largest value less the second largest; null for fewer than two."""
    ordered = F.sort_array(values, asc=False)
    return F.when(F.size(values) > 1, F.abs(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))))


def unit_sum(values: Column) -> Column:
    """An array scaled to sum 1; null where its sum isn't positive."""
    return let(values, lambda v: let(array_sum(v), lambda total: F.when(total > 0, F.transform(v, lambda x: x / total))))


def softmax(values: Column) -> Column:
    return unit_sum(let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top))))


def squared_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; a constant column scales to 0."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value.isNotNull(), 0.0))


def hash_unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from integer columns, the same in any SQL engine and partitioning."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *[part.cast("string") for part in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def hash_unit_sql(seed: int, *parts: str) -> str:
    """The SQL of ``hash_unit``."""
    joined = " || '/' || ".join([f"'{seed}'", *[f"({part})::bigint::varchar" for part in parts]])
    return f"(('0x' || md5({joined})[1:8])::bigint / {1 << 32}.0::double)"


def folded(text: Column) -> Column:
    """Lower case in which a sigma is the same at the end of a word, as engines differ there."""
    return F.translate(F.lower(text), "ς", "σ")
