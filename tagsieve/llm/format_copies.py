"""Copies of records that differ only in formatting.

Two records are copies if their label and text agree in letters and digits, lower-cased and
in order. Texts of two or more named fields (``item: a | place: b``, ``{"place": "b", ...}``,
``[item] a``, ``item=a; ...``, ``item - a, ...``) agree if they hold the same fields with the
same values in that sense, in any order. Combining marks count as part of their letters.

Method: every record gets a 64-bit hash of its canonical form. Each partition fills two Bloom
filters, of hashes seen once and of hashes seen again; merging two partitions adds to the
second what both have in the first. Only records that the merged second filter holds are
shuffled and grouped by a 256-bit digest; all others are singletons and stay where they are.
A Bloom filter never misses a key, so no copy is lost; false hits only cost shuffle.

A filter of fixed size holds a share of the hashes, so more records take more passes. Each
pass reads its own share of the written hashes only, so each hash is read twice however many
passes there are, and at most one filter is held at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.operators.skew import skew_join
from tagsieve.plans.runtime import checkpoint, stored, stored_path

#: Bits of one filter segment, and bits that a hash sets in its segment.
SEGMENT_BITS = 1 << 16
BITS_PER_HASH = 4
#: Filter bits for every record: about one single record in 2,000 then passes as a possible repeat.
BITS_PER_RECORD = 8
#: Largest filter that is broadcast at once; more records take more passes, each over its share of the hashes.
MAX_FILTER_BYTES = 64 << 20
#: Folders that the written hashes are parted into; passes beyond share folders, where they lie in order.
FOLDERS = 64

SEGMENT_BYTES = SEGMENT_BITS // 8


def letters(column: Column) -> Column:
    """The letters, marks and digits of a text, lower-cased."""
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{M}\p{N}]+", "")


#: What may stand before the name of a field: at the start of the text, or between fields.
AT_START, BETWEEN = r"^[^\p{L}\p{N}]*", r"[|,;\n{]\s*"


def field_marker(names: list[str], before: str) -> str:
    """A pattern for the start of a named field: what stands before it, the name and its sign."""
    name = "(?:" + "|".join(names) + ")"
    return rf'(?i)(?:{before})(?:\[\s*{name}\s*\]|"\s*{name}\s*"\s*:|{name}\s*[:=]|{name}\s+-\s)'


def canonical_text(text: Column, names: list[str]) -> Column:
    """The letters and digits of a text; of two or more named fields, sorted by field."""
    marker = field_marker(names, f"{AT_START}|{BETWEEN}")
    marks = F.regexp_extract_all(text, F.lit(marker), F.lit(0))
    values = F.split(text, marker)
    fields = F.transform(
        F.arrays_zip(marks.alias("m"), F.slice(values, 2, F.size(values)).alias("v")),
        lambda x: F.concat(letters(x["m"]), F.lit("="), letters(x["v"])),
    )
    fielded = text.rlike(field_marker(names, AT_START)) & (F.size(marks) > 1)
    return F.when(fielded, F.concat(F.lit("\u0001"), F.array_join(F.array_sort(fields), "\u0002"))).otherwise(letters(text))


def canonical(df: DataFrame, row_id: str, text: str, label: str | None, names: list[str]) -> DataFrame:
    """``(row_id, h, digest)`` of every row whose text isn't null; null labels agree with each other."""
    own = canonical_text(F.col(text), names)
    side = F.lit("") if label is None else F.coalesce(F.concat(F.lit("+"), letters(F.col(label))), F.lit("-"))
    whole = F.concat(own, F.lit("\u0003"), side)
    keyed = df.where(F.col(text).isNotNull()).select(row_id, whole.alias("whole"))
    return keyed.select(row_id, F.xxhash64("whole").alias("h"), F.unhex(F.sha2("whole", 256)).alias("digest"))


@dataclass(frozen=True)
class Layout:
    """How hashes fall on the segments of a filter, and on the passes that fill them."""

    segments: int
    per_pass: int

    @classmethod
    def of(cls, records: int, max_bytes: int = MAX_FILTER_BYTES) -> Layout:
        segments = max(1, -(-records * BITS_PER_RECORD // SEGMENT_BITS))
        return cls(segments, min(segments, max(1, max_bytes // SEGMENT_BYTES)))

    @property
    def passes(self) -> int:
        return -(-self.segments // self.per_pass)

    def pass_of(self, h: Column) -> Column:
        """The number of the pass that a hash takes part in."""
        return F.floor(F.pmod(h, F.lit(self.segments).cast("long")) / F.lit(self.per_pass)).cast("int")

    def folder(self, number: int) -> int:
        """The folder of a pass: every pass has its own where these suffice."""
        return number * FOLDERS // max(self.passes, FOLDERS)

    def bits(self, h: np.ndarray, first: int) -> np.ndarray:
        """The bits of each hash, as ``(n, BITS_PER_HASH)`` positions in a pass's filter."""
        segment = np.mod(h, self.segments) - first
        mixed = h.view(np.uint64).copy()
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        parts = [(mixed >> np.uint64(16 * k)) & np.uint64(SEGMENT_BITS - 1) for k in range(BITS_PER_HASH)]
        return segment[:, None] * SEGMENT_BITS + np.stack(parts, axis=1).astype(np.int64)


def set_bits(filled: np.ndarray, bits: np.ndarray) -> None:
    flat = bits.ravel()
    np.bitwise_or.at(filled, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))


def has_bits(filled: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((filled[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).all(axis=1)


def add_hashes(once: np.ndarray, again: np.ndarray, h: np.ndarray, layout: Layout, first: int) -> None:
    """Note a batch of hashes; those seen before, or twice in the batch, as seen again."""
    unique, counts = np.unique(h, return_counts=True)
    bits = layout.bits(unique, first)
    repeated = (counts > 1) | has_bits(once, bits)
    set_bits(again, bits[repeated])
    set_bits(once, bits)


def merge(once: np.ndarray, again: np.ndarray, other_once: np.ndarray, other_again: np.ndarray) -> None:
    again |= other_again | (once & other_once)
    once |= other_once


def _partial_filters(layout: Layout, first: int):
    import pyarrow as pa

    def fill(batches: Iterator) -> Iterator:
        size = layout.per_pass * SEGMENT_BYTES
        once, again = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            if batch.num_rows:
                add_hashes(once, again, batch.column(0).to_numpy(zero_copy_only=False), layout, first)
        rows = once.reshape(-1, SEGMENT_BYTES)
        pack = lambda x: zlib.compress(x.tobytes(), 1)
        touched = np.flatnonzero(rows.any(axis=1))
        for part in np.array_split(touched, max(1, len(touched) // 256)):
            columns = [
                pa.array(part.astype(np.int32)),
                pa.array([pack(rows[s]) for s in part], pa.binary()),
                pa.array([pack(again[s * SEGMENT_BYTES : (s + 1) * SEGMENT_BYTES]) for s in part], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "once", "again"])

    return fill


def _merge_sorted(batches: Iterator) -> Iterator:
    """Merge the partial filters of each segment, which arrive in order, in constant memory."""
    import pyarrow as pa

    unpack = lambda x: np.frombuffer(zlib.decompress(x), np.uint8)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([again.tobytes()], pa.binary())], ["segment", "again"])

    at, once, again = None, None, None
    for batch in batches:
        for segment, o, a in zip(*(c.to_pylist() for c in batch.columns)):
            if segment != at:
                if at is not None and again.any():
                    yield row()
                at, once, again = segment, unpack(o).copy(), unpack(a).copy()
            else:
                merge(once, again, unpack(o), unpack(a))
    if at is not None and again.any():
        yield row()


def repeat_filter(hashes: DataFrame, layout: Layout, number: int) -> np.ndarray:
    """The merged filter, of at most ``per_pass`` segments, of the hashes of a pass seen more than once."""
    partial = hashes.mapInArrow(_partial_filters(layout, number * layout.per_pass), "segment int, once binary, again binary")
    merged = partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge_sorted, "segment int, again binary")
    filled = np.zeros(layout.per_pass * SEGMENT_BYTES, np.uint8)
    for segment, again in merged.collect():
        filled[segment * SEGMENT_BYTES : (segment + 1) * SEGMENT_BYTES] = np.frombuffer(again, np.uint8)
    return filled


def store_by_pass(keyed: DataFrame, layout: Layout) -> DataFrame:
    """``keyed`` as a written table with the number of each row's ``pass``, parted into the passes' folders without a shuffle."""
    if layout.passes == 1:
        return stored(keyed.select("*", F.lit(0).alias("pass"), F.lit(0).alias("folder")), "folder")
    number = layout.pass_of(F.col("h"))
    folder = F.floor(number * FOLDERS / F.lit(max(layout.passes, FOLDERS))).cast("int")
    placed = keyed.select("*", number.alias("pass"), folder.alias("folder"))
    return stored(placed.sortWithinPartitions("folder", "pass"), "folder")


def mark_possible_repeats(kept: DataFrame, layout: Layout) -> DataFrame:
    """``(row_id, maybe, digest)`` of all rows: ``maybe`` is false, and the digest null, only where the hash occurs exactly once.

    With several passes the rows of each are written before its filter is released.
    """
    context, path = kept.sparkSession.sparkContext, None
    for number in range(layout.passes):
        own = kept.where((F.col("folder") == layout.folder(number)) & (F.col("pass") == number))
        shared, first = context.broadcast(repeat_filter(own.select("h"), layout, number)), number * layout.per_pass

        def held(h, shared=shared, first=first):
            import pandas as pd

            return pd.Series(has_bits(shared.value, layout.bits(h.to_numpy(np.int64), first)))

        maybe = own.withColumn("maybe", F.pandas_udf(held, "boolean")("h"))
        marked = maybe.select("row_id", "maybe", F.when(F.col("maybe"), F.col("digest")).alias("digest"))
        path = path or stored_path(kept.sparkSession)
        marked.write.partitionBy("maybe").parquet(f"{path}/number={number}")
        shared.destroy()
    return kept.sparkSession.read.schema(marked.schema).parquet(path)


class FormatCopies:
    """Copies among ``df``, found once and read as pairs or as collapsed records.

    Rows with a null text have no copies and come out as their own record. Texts without
    any letter or digit agree with each other. Repeated ids count as rows of their own but
    give no pair with themselves. Columns other than those named are neither read nor
    returned, so their names can't clash; an empty table has no rows.
    """

    def __init__(
        self,
        df: DataFrame,
        field_names: list[str],
        row_id: str = "id",
        text: str = "text",
        label: str | None = "noisy",
        max_filter_bytes: int = MAX_FILTER_BYTES,
    ):
        self.row_id = row_id
        self.rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), *([] if label is None else [F.col(label).alias("label")]))
        # hashes and digests, some fifty bytes a record, are kept, so that each text is taken apart once
        layout = Layout.of(df.count(), max_filter_bytes)
        keyed = canonical(self.rows, "row_id", "text", None if label is None else "label", field_names)
        marked = mark_possible_repeats(store_by_pass(keyed, layout), layout)
        self.singles = marked.where(~F.col("maybe")).select("row_id")
        self.possible = marked.where("maybe").select("row_id", "digest")
        grouped = self.possible.groupBy("digest").agg(F.min("row_id").alias("keep_id"), F.count("*").alias("copies"))
        self.groups = checkpoint(grouped)

    def pairs(self) -> DataFrame:
        """``(keep_id, copy_id)`` for every record that is a copy of one with a smaller id."""
        several = self.groups.where("copies > 1").select("digest", "keep_id", "copies")
        total = F.broadcast(several.agg(F.sum("copies").alias("total")))
        heavy = several.crossJoin(total).where("copies >= 0.005 * total").select("digest")
        joined = skew_join(self.possible, several, "digest", heavy=heavy, right_unique=True)
        return joined.where("row_id > keep_id").select("keep_id", F.col("row_id").alias("copy_id"))

    def records(self) -> DataFrame:
        """``(keep_id, copies)`` of every distinct record; ``copies`` counts the kept one too."""
        null_text = self.rows.where("text is null").select("row_id")
        alone = self.singles.unionByName(null_text).select(F.col("row_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
        return alone.unionByName(self.groups.select("keep_id", "copies"))
