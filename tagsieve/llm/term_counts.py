"""Occurrences and records of every distinct term, by last-seen counters.

Terms are hash-partitioned together with a bucket of the record and each partition is
ordered by record. A partition then keeps, for each term, its occurrences, its records and
the last record it was seen in: a row of another record than the last adds one to the
records. No set of records is kept. All rows of a term in one record fall in one partition,
so the counters of the buckets add up exactly, and a term of a third of all rows is spread
over as many partitions as there are buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsieve.plans.runtime import shuffle_width

#: Terms that a partition keeps before it hands on its counts.
MAX_TERMS = 1_000_000
#: Stands for a null record identifier, which counts as one record.
NULL_RECORD = -(1 << 63)


class LastSeen:
    """Counters of terms over rows that come ordered by record."""

    def __init__(self) -> None:
        self.place: dict[tuple[int, str], int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.zeros(1024, np.int64)
        self.known = np.zeros(1024, bool)

    def add(self, terms: list[tuple[int, str]], codes: np.ndarray, records: np.ndarray) -> None:
        """``terms`` are distinct; row i is ``terms[codes[i]]`` in ``records[i]``, which ascend."""
        places = np.array([self.place.setdefault(t, len(self.place)) for t in terms], np.int64)
        while len(self.place) > len(self.last):
            for name in ("occurrences", "records", "last", "known"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        order = np.argsort(codes, kind="stable")
        code, record = codes[order], records[order]
        head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        fresh = np.r_[True, record[1:] != record[:-1]]
        at = places[code[head]]
        fresh[head] = ~self.known[at] | (self.last[at] != record[head])
        tail = np.r_[head[1:], len(code)] - 1
        self.occurrences[at] += tail - head + 1
        self.records[at] += np.add.reduceat(fresh.astype(np.int64), head)
        self.last[at] = record[tail]
        self.known[at] = True

    def drain(self, current: int | None) -> tuple[list[tuple[int, str]], np.ndarray, np.ndarray]:
        """Hand on all counts; terms of the record ``current`` stay known as seen in it."""
        n = len(self.place)
        terms = list(self.place)
        counts = self.occurrences[:n].copy(), self.records[:n].copy()
        kept = [t for t in terms if current is not None and self.last[self.place[t]] == current]
        self.__init__()
        if kept:
            self.add(kept, np.arange(len(kept)), np.full(len(kept), current, np.int64))
            self.occurrences[: len(kept)] = self.records[: len(kept)] = 0
        keep = counts[0] > 0
        return [t for t, k in zip(terms, keep) if k], counts[0][keep], counts[1][keep]


def _counters(max_terms: int):
    import pyarrow as pa

    def out(drained: tuple) -> pa.RecordBatch:
        terms, occurrences, records = drained
        columns = [pa.array([t[0] for t in terms], pa.int8()), pa.array([t[1] for t in terms], pa.string()), pa.array(occurrences), pa.array(records)]
        return pa.RecordBatch.from_arrays(columns, ["field", "term", "occurrences", "records"])

    def count(batches: Iterator) -> Iterator:
        counters = LastSeen()
        for batch in batches:
            if not batch.num_rows:
                continue
            terms = batch.column(1).dictionary_encode()
            wide = len(terms.dictionary)
            pair = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * wide + terms.indices.to_numpy()
            distinct, codes = np.unique(pair, return_inverse=True)
            values = terms.dictionary.to_pylist()
            records = batch.column(2).to_numpy(zero_copy_only=False)
            counters.add([(p // wide, values[p % wide]) for p in distinct.tolist()], codes, records)
            if len(counters.place) > max_terms:
                yield out(counters.drain(int(records[-1])))
        yield out(counters.drain(None))

    return count


def term_counts(df: DataFrame, fields: dict[str, Column], record: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """``(field, term, occurrences, records)`` of every distinct value of each of ``fields``.

    ``fields`` names the counted expressions. Null is no term and isn't counted; the empty
    string is one. Repeated rows count each time; a null ``record`` counts as one record.
    An empty table has no terms. Other columns of ``df`` are not read. ``record`` must be
    an integer column.
    """
    if not isinstance(df.schema[record].dataType, T.IntegralType):
        raise ValueError(f"{record} isn't an integer column")
    own = F.coalesce(F.col(record).cast("long"), F.lit(NULL_RECORD)).alias("record")
    # fields travel as their number, terms as they are
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("field"), v.alias("term")) for k, v in enumerate(fields.values())])).alias("t")
    rows = df.select(own, each).select("t.field", "t.term", "record").where("term is not null")
    width = shuffle_width(df.sparkSession)
    bucket = F.pmod(F.xxhash64("record"), F.lit(width))
    ordered = rows.repartition(width, F.col("field"), F.col("term"), bucket).sortWithinPartitions("record")
    partial = ordered.mapInArrow(_counters(max_terms), "field byte, term string, occurrences long, records long")
    summed = partial.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return summed.withColumn("field", F.get(F.array(*[F.lit(name) for name in fields]), F.col("field")))


def mark_terms(counts: DataFrame, df: DataFrame, record: str, least: int = 3, most: float = 0.5) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` below ``least`` records, ``common`` above the share ``most`` of all, else ``useful``.

    The records of ``df`` are all distinct values of ``record``, a null one included. A term
    that is both rare and common, as in a table of a record or two, is ``rare``.
    """
    total = df.agg(F.countDistinct(record).alias("n"), F.max(F.col(record).isNull().cast("int")).alias("null")).select(
        (F.col("n") + F.coalesce("null", F.lit(0))).alias("all_records")
    )
    mark = F.when(F.col("records") < least, "rare").when(F.col("records") > most * F.col("all_records"), "common").otherwise("useful")
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("all_records")
