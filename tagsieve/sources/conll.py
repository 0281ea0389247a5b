"""Token-labelled sentences in blocks of lines parted by blank lines, three tab-separated fields a line."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsieve.plans.runtime import checkpoint
from tagsieve.sources.ranges import RANGE_BYTES, RangeText, byte_ranges, dealt_out

#: Bytes before a range that are looked at to tell whether a sentence begins where it does.
BACK_BYTES = 1 << 16


def _begun_sentences(row) -> Iterator[list[str]]:
    """The sentences, as lists of lines, whose first line begins in a range."""
    at = max(0, row.begin - BACK_BYTES)
    text = RangeText(row.file_name, at, row.end, row.size)
    place, blank, own = 0, at == 0, None
    while True:
        stop = text.text.find("\n", place)
        while stop < 0 and not text.whole:
            text.more()
            stop = text.text.find("\n", place)
        line = text.text[place : len(text.text) if stop < 0 else stop]
        if not line.strip():
            if own:
                yield own
            own = None
            if at >= row.end:
                return
        elif own is not None:
            own.append(line)
        elif blank and at >= row.end:
            return
        elif blank and at >= row.begin:
            own = [line]
        blank = not line.strip()
        if stop < 0:
            break
        at, place = at + len(line.encode("utf-8", "surrogateescape")) + 1, stop + 1
    if own:
        yield own


def read_conll(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file_name, sent_no, pos, token, gold, noisy)`` of every line that has fields.

    Files are read in ranges of ``range_bytes``, each by a task that takes the sentences
    which begin in it; a first reading counts them, so that ``sent_no`` numbers those of a
    file from 0. A line of white space ends a sentence, and a carriage return before a line
    break belongs to it. Lines with fewer than three fields have null labels; further
    fields are left out. An empty file has no rows; undecodable bytes become U+FFFD.
    """
    ranges = byte_ranges(spark, path, range_bytes).select("file_name", "size", "begin", "end")

    def count(frames: Iterator) -> Iterator:
        import pandas as pd

        for row in (row for frame in frames for row in frame.itertuples(index=False)):
            yield pd.DataFrame({"file_name": [row.file_name], "size": [row.size], "begin": [row.begin], "end": [row.end], "n": [sum(1 for _ in _begun_sentences(row))]})

    counted = ranges.mapInPandas(count, "file_name string, size long, begin long, end long, n long")
    before = Window.partitionBy("file_name").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    kept = checkpoint(counted)  # some bytes a range
    numbered = dealt_out(kept.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0"))

    def parse(frames: Iterator) -> Iterator:
        import pandas as pd

        for row in (row for frame in frames for row in frame.itertuples(index=False)):
            rows = []
            for number, lines in enumerate(_begun_sentences(row), row.first):
                for pos, line in enumerate(lines):
                    fields = line.removesuffix("\r").encode("utf-8", "surrogateescape").decode("utf-8", "replace").split("\t")
                    rows.append((row.file_name, number, pos, *[fields[k] if k < len(fields) else None for k in range(3)]))
                if len(rows) > 10_000:
                    yield pd.DataFrame(rows, columns=["file_name", "sent_no", "pos", "token", "gold", "noisy"])
                    rows = []
            yield pd.DataFrame(rows, columns=["file_name", "sent_no", "pos", "token", "gold", "noisy"])

    return numbered.mapInPandas(parse, "file_name string, sent_no int, pos int, token string, gold string, noisy string")


def with_sentence_ids(lines: DataFrame) -> DataFrame:
    """The lines with ``sent_id``: a number that is the same for any partitioning, from file and sentence."""
    return lines.withColumn("sent_id", F.xxhash64("file_name", "sent_no")).select("sent_id", "pos", "token", "gold", "noisy")


def write_conll(tokens: DataFrame, path: str) -> None:
    """Write sentences in blocks that the reader reads back; nulls become empty fields."""
    rows = tokens.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "gold", "noisy"))).alias("rows"))
    line = F.transform("rows", lambda x: F.concat_ws("\t", *[F.coalesce(x[c], F.lit("")) for c in ("token", "gold", "noisy")]))
    rows.select(F.concat(F.array_join(line, "\n"), F.lit("\n")).alias("value")).write.text(path)
