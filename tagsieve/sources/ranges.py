"""Byte ranges of files, so that a file of any size is read by many tasks.

A range begins and ends anywhere; its reader finds the first record that begins in it and
reads on past its end to finish the last one.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range.
RANGE_BYTES = 64 << 20
#: Tasks that ranges are dealt out to.
MOST_TASKS = 100_000
#: Bytes that are read on at first where a record goes on past the end of its range.
MORE_BYTES = 1 << 16


def byte_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file_name, size, begin, end)`` of all ranges of the files of ``path``, dealt out to tasks; an empty file has none."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_name"), F.col("length").alias("size")).where("size > 0")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("file_name", "size", begins.alias("begin"))
    return dealt_out(ranges.withColumn("end", F.least(F.col("begin") + range_bytes, "size")))


def dealt_out(ranges: DataFrame) -> DataFrame:
    """The ranges one to a task, or evenly where there are very many: a row stands for many bytes, which the planner can't know."""
    return ranges.repartition(min(max(ranges.count(), 1), MOST_TASKS))


@lru_cache(64)
def _system(scheme: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(scheme)[0]


class RangeText:
    """The text of a file from a byte on, read as far as it is asked for; undecodable bytes become lone surrogates."""

    def __init__(self, file_name: str, begin: int, upto: int, size: int):
        from urllib.parse import unquote, urlsplit

        parts = urlsplit(file_name)
        local = parts.scheme in ("", "file")
        self.system = _system("file:///") if local else _system(f"{parts.scheme}://{parts.netloc}/")
        self.path = unquote(parts.path) if local else parts.netloc + unquote(parts.path)
        self.size, self.read_to, self.rest, self.text = size, begin, b"", ""
        self.more(upto - begin)

    @property
    def whole(self) -> bool:
        return self.read_to >= self.size

    def more(self, count: int = 0) -> None:
        """Read on, at least as much as there is already."""
        count = min(max(count, len(self.text), MORE_BYTES), self.size - self.read_to)
        with self.system.open_input_file(self.path) as file:
            file.seek(self.read_to)
            raw = self.rest + file.read(count)
        self.read_to += count
        cut = len(raw)
        if not self.whole:  # a character that the end cuts in two waits for its rest
            while cut and cut > len(raw) - 4 and raw[cut - 1] & 0xC0 == 0x80:
                cut -= 1
            cut -= bool(cut and raw[cut - 1] >= 0xC0)
        self.rest = raw[cut:]
        self.text += raw[:cut].decode("utf-8", "surrogateescape")
