"""Tab-separated text classification records, parsed by an error-recovering recursive descent.

Grammar of one record::

    record = field { TAB field } [ CR ] end
    field  = quoted | plain
    quoted = '"' { any but '"' | '""' } '"'      followed by TAB or the end
    plain  = { any but TAB }                     not beginning with '"'

A valid record has three fields: a text, and a gold and a noisy label out of the label set.
A record that breaks a rule becomes a located error, and the parser goes on at the next
anchor: the next place where a record is known to begin or, where none is known, the next
line start at which a whole valid record can be parsed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsieve.plans.runtime import stored
from tagsieve.sources.ranges import RANGE_BYTES, RangeText, byte_ranges, dealt_out

#: U+FFFD, undecodable bytes, and control characters other than tab and line breaks.
BAD_CHARACTERS = re.compile("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff]")
#: Line numbers of a part of a file whose lines are rows.
PART_LINES = 20_000
NOT_QUOTE = re.compile('[^"]*')


@dataclass(frozen=True)
class Record:
    texts: str
    gold: str
    noisy: str
    begin: int
    end: int


@dataclass(frozen=True)
class Broken(Exception):
    """Why and where a record fails: ``field`` from 0, ``at`` and ``end`` as offsets into the input."""

    reason: str
    field: int
    at: int
    end: int


class Descent:
    """Parser over one string of records parted by line breaks.

    ``starts`` has the places at which records are known to begin, the first being 0; a
    record then ends before the line break that parts it from the next, and may hold others.
    """

    def __init__(self, source: str, labels: Iterable[str], starts: list[int] | None = None):
        self.source, self.labels, self.starts = source, frozenset(labels), starts
        self.size = len(source)
        self.bound: int | None = None  # the end of the record at hand, without its last carriage return, if it is known
        self.stop = self.size  # the end of what may belong to the record at hand
        self.furthest = 0  # the last place looked at

    def limit(self, at: int) -> int:
        """End of the record's last line when it holds no quoted line break."""
        if self.bound is not None:
            return self.bound
        end = self.source.find("\n", at)
        end = self.size if end < 0 else end
        self.furthest = max(self.furthest, end)
        return end - (end > at and self.source[end - 1] == "\r")

    def at_end(self, at: int) -> bool:
        """Whether the record may end at ``at``."""
        if self.bound is not None:
            return at >= self.bound
        self.furthest = max(self.furthest, at + 1)
        return at >= self.size or self.source[at] == "\n" or (self.source[at] == "\r" and (at + 1 >= self.size or self.source[at + 1] == "\n"))

    def record(self, begin: int) -> Record:
        fields: list[tuple[str, int]] = []
        at = begin
        while True:
            value, stop = self.field(at, len(fields))
            fields.append((value, at))
            if self.at_end(stop):
                break
            at = stop + 1
        if len(fields) != 3:
            raise Broken("columns", min(len(fields), 3), fields[3][1] if len(fields) > 3 else stop, stop)
        for number in (1, 2):
            if fields[number][0] not in self.labels:
                raise Broken("value", number, fields[number][1], stop)
        text = fields[0][0]
        if not text.strip():
            raise Broken("value", 0, begin, stop)
        if bad := BAD_CHARACTERS.search(text):
            raise Broken("value", 0, begin + bad.start(), stop)
        return Record(text, fields[1][0], fields[2][0], begin, stop)

    def field(self, at: int, number: int) -> tuple[str, int]:
        return self.quoted(at, number) if self.source.startswith('"', at) else self.plain(at)

    def plain(self, at: int) -> tuple[str, int]:
        limit = self.limit(at)
        tab = self.source.find("\t", at, limit)
        stop = limit if tab < 0 else tab
        return self.source[at:stop], stop

    def quoted(self, at: int, number: int) -> tuple[str, int]:
        stop = at + 1
        while True:
            stop = NOT_QUOTE.match(self.source, stop, self.stop).end()
            self.furthest = max(self.furthest, stop + 1)
            if stop >= self.stop:
                raise Broken("quoting", number, at, self.stop)
            if not self.source.startswith('"', stop + 1, self.stop):
                break
            stop += 2
        after = stop + 1
        if not (self.at_end(after) or self.source.startswith("\t", after)):
            raise Broken("quoting", number, after, after)
        return self.source[at + 1 : stop].replace('""', '"'), after

    def next_line(self, at: int) -> int:
        end = self.source.find("\n", at)
        self.furthest = max(self.furthest, self.size if end < 0 else end)
        return self.size if end < 0 else end + 1

    def is_anchor(self, at: int) -> bool:
        try:
            self.record(at)
        except Broken:
            return False
        return True

    def records(self) -> Iterator[tuple[int, Record | Broken]]:
        """``(begin, record or error)`` of every record; after an error at the next anchor.

        An error in the quoting makes it unknown where the record ends, unless it is known
        where the next begins: its line and every following line up to the next anchor
        belong to it. Other errors end where their record ends.
        """
        if self.starts is not None:
            yield from self.known_records()
            return
        at = 0
        while at < self.size:
            found, after = self.one(at)
            yield at, found
            at = after

    def known_records(self) -> Iterator[tuple[int, Record | Broken]]:
        for begin, after in zip(self.starts, [*self.starts[1:], self.size + 1]):
            self.stop = after - 1
            self.bound = self.stop - (self.stop > begin and self.source[self.stop - 1] == "\r")
            try:
                yield begin, self.record(begin)
            except Broken as error:
                yield begin, error

    def one(self, at: int) -> tuple[Record | Broken, int]:
        """The record or error at a place, and where the next begins."""
        try:
            found: Record | Broken = self.record(at)
            return found, self.next_line(found.end)
        except Broken as error:
            after = self.next_line(at if error.reason == "quoting" else error.end)
            return error, self.next_anchor(after) if error.reason == "quoting" else after

    def next_anchor(self, at: int) -> int:
        while at < self.size and not self.is_anchor(at):
            at = self.next_line(at)
        return at


def parse_one(line: str | None, labels: Iterable[str]) -> Record | Broken:
    """The record that ``line`` holds; a null line has no columns."""
    return parse_known([line], labels)[0]


def parse_known(lines: list[str | None], labels: Iterable[str]) -> list[Record | Broken]:
    """The record or error of each line, which are parsed as one source whose record starts are known.

    Places count from the line's begin; a null line has no columns.
    """
    texts = [line or "" for line in lines]
    starts = [0, *accumulate(len(t) + 1 for t in texts)][: len(texts)]
    found = [x for _, x in Descent("\n".join(texts), labels, starts).records()] if texts else []
    placed = [
        replace(x, begin=0, end=x.end - begin) if isinstance(x, Record) else Broken(x.reason, x.field, x.at - begin, x.end - begin) for x, begin in zip(found, starts)
    ]
    return [Broken("columns", 0, 0, 0) if line is None else x for line, x in zip(lines, placed)]


PARSED = T.StructType(
    [
        T.StructField("texts", T.StringType()),
        T.StructField("gold", T.StringType()),
        T.StructField("noisy", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("error_field", T.IntegerType()),
        T.StructField("error_at", T.IntegerType()),
    ]
)


def _row(found: Record | Broken, begin: int = 0) -> tuple:
    if isinstance(found, Record):
        return found.texts, found.gold, found.noisy, None, None, None
    return None, None, None, found.reason, found.field, found.at - begin


def label_values(label_set: DataFrame, limit: int = 100_000) -> list[str]:
    """The labels of a label set as a list; an unbounded set is refused, not cut."""
    values = [r[0] for r in label_set.where("label is not null").select("label").distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"the label set has more than {limit} labels")
    return values


def parse_records(lines: DataFrame, label_set: DataFrame, row_id: str = "line_id", line: str = "line") -> DataFrame:
    """Parse one record a row: ``(row_id, texts, gold, noisy, reason, error_field, error_at)``.

    Valid records have a null ``reason``; failed ones have null ``texts``, ``gold`` and
    ``noisy``, and the reason ``quoting``, ``columns`` or ``value`` with the field (from 0)
    and the offset at which they fail. Every row of ``lines`` gives one row, repeated and
    null ones included: a null or empty line fails with ``columns``. Columns of ``lines``
    other than the two named are left out, so that none can clash.
    """
    labels = label_values(label_set)
    schema = T.StructType([T.StructField(row_id, lines.schema[row_id].dataType), *PARSED])
    names = schema.names

    def parse(batches):
        import pyarrow as pa

        types = None
        for batch in batches:
            found = [_row(x) for x in parse_known(batch.column(1).to_pylist(), labels)]
            types = types or [pa.string()] * 4 + [pa.int32()] * 2
            columns = [pa.array([row[k] for row in found], types[k]) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return lines.select(row_id, line).mapInArrow(parse, schema)


def valid_records(parsed: DataFrame, row_id: str = "line_id") -> DataFrame:
    return parsed.where("reason is null").select(row_id, "texts", "gold", "noisy")


def failed_records(parsed: DataFrame, row_id: str = "line_id") -> DataFrame:
    return parsed.where("reason is not null").select(row_id, "reason", "error_field", "error_at")


def load_text_classification_tsv(spark: SparkSession, path: str, label_set: DataFrame, multiline: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of TSV files without header: ``(file_name, begin_at, texts, gold, noisy, reason, ...)``.

    ``begin_at`` is the byte at which the record begins. Files are read in ranges of
    ``range_bytes``, each by a task that begins at the first anchor in it; a first reading
    makes sure that every range begins where the one before ends, as a line within a quoted
    field may look like a record, and lets a range that doesn't begin there instead.
    Without ``multiline`` every line is a record, a quoted field that goes on in the next
    line fails with ``quoting``, and ``begin_at`` is null. An empty file has no records.
    """
    labels = label_values(label_set)
    if not multiline:
        lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file_name"), "value")
        parsed = parse_records(lines, label_set, "file_name", "value")
        return parsed.select("file_name", F.lit(None).cast("long").alias("begin_at"), *PARSED.names)
    ranges = byte_ranges(spark, path, range_bytes).withColumn("start", F.lit(None).cast("long"))
    starts = []
    if not ranges.where("begin > 0").isEmpty():

        def ends(frames):
            import pandas as pd

            for row in (row for frame in frames for row in frame.itertuples(index=False)):
                _, first, after = _range_records(row, labels)
                yield pd.DataFrame({"file_name": [row.file_name], "begin": [row.begin], "first": [first], "after": [after]})

        starts = settled_starts(spark, ranges, ends)
    if starts:
        moved = spark.createDataFrame(starts, "file_name string, begin long, moved long")
        ranges = dealt_out(ranges.join(F.broadcast(moved), ["file_name", "begin"], "left").withColumn("start", F.col("moved")))
    schema = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("begin_at", T.LongType()), *PARSED])

    def parse(frames):
        import pandas as pd

        for row in (row for frame in frames for row in frame.itertuples(index=False)):
            rows = [(row.file_name, begin, *_row(found, begin_text)) for begin, begin_text, found in _range_records(row, labels)[0]]
            yield pd.DataFrame(rows, columns=schema.names).astype({"error_field": "Int32", "error_at": "Int32"})

    return ranges.select("file_name", "size", "begin", "end", "start").mapInPandas(parse, schema)


Begun = list[tuple[int, int, Record | Broken]]


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


def _range_records(row, labels: list[str]) -> tuple[Begun, int, int]:
    """``begun_records`` of a byte range of a file."""
    known = row.start is not None and row.start == row.start
    begin = int(row.start) if known else row.begin
    offset = max(0, begin - 1)  # a line break there says that a line begins at the range
    text = RangeText(row.file_name, offset, row.end, row.size)
    place = begin - offset if known or begin == 0 else None
    return begun_records(text, offset, place, row.end, _bytes, labels)


def begun_records(text, offset: int, place: int | None, end: int, size: Callable[[str], int], labels: list[str]) -> tuple[Begun, int, int]:
    """The records that begin in a part of a source, as ``(offset, place in the text, record)``, the first one's offset, and that of the first valid record after the part.

    ``text`` starts at ``offset`` and may read on; offsets count by ``size``. The first
    record begins at ``place``, or at the first anchor after a line break. Broken records
    that begin after ``end`` but before the next valid one belong to the part, as the next
    part begins at its first valid record.
    """

    def on(act):
        """What ``act`` gives for as much text as it needs: more is read where it came to the end of what there is."""
        while True:
            parser = Descent(text.text, labels)
            result, reached = act(parser)
            if max(reached, parser.furthest) < len(text.text) or text.whole:
                return result
            text.more()

    def first(parser: Descent):
        found = parser.next_anchor(parser.next_line(0))
        return found, found

    def next_one(parser: Descent):
        found = parser.one(at)
        return found, found[1]

    at = on(first) if place is None else place
    reached, found, begun = offset + size(text.text[:at]), [], None
    while at < len(text.text) or not text.whole:
        record, after = on(next_one)
        if reached >= end and isinstance(record, Record):
            break
        begun = reached if begun is None else begun
        found.append((reached, at, record))
        reached, at = reached + size(text.text[at:after]), after
    return found, reached if begun is None else begun, reached


def settled_starts(spark: SparkSession, parts: DataFrame, ends: Callable) -> list[tuple[str, int, int]]:
    """``(file_name, begin, start)`` of the parts that must not begin at their own first anchor.

    ``ends`` gives where a part's records begin and end; only these places come to the
    driver, some bytes for each part.
    """
    found = parts.mapInPandas(ends, "file_name string, begin long, first long, after long")
    known = {(r.file_name, r.begin): (r.first, r.after) for r in found.collect()}
    moved: dict[tuple[str, int], int] = {}
    moved: dict[tuple[str, int], int] = {}
    while wrong := _wrong_starts(known):
        moved |= {(name, begin): start for name, begin, start in wrong}
        again = parts.drop("start").join(F.broadcast(spark.createDataFrame(wrong, "file_name string, begin long, start long")), ["file_name", "begin"])
        again = again.select(*parts.columns).mapInPandas(ends, found.schema)
        known |= {(r.file_name, r.begin): (r.first, r.after) for r in again.collect()}
    return [(*key, start) for key, start in moved.items()]


def _wrong_starts(known: dict[tuple[str, int], tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The first part of each source that doesn't begin where the one before ends, and where that is."""
    wrong, expected, source, lost = [], 0, None, False
    for key in sorted(known):
        if key[0] != source:
            source, expected, lost = key[0], known[key][0], False
        first, after = known[key]
        if not lost and first != expected:
            wrong.append((*key, expected))
            lost = True  # where the next parts begin depends on where this one ends
        expected = after
    return wrong


@dataclass(frozen=True)
class Lines:
    """The text of a part and what follows it; no more can be read."""

    text: str
    whole: bool = True


def parse_lines_by_file(lines: DataFrame, label_set: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """Records of the files whose lines ``(file_name, line_no, line)`` are rows: ``(file_name, begin_at, texts, gold, noisy, reason, ...)``.

    Lines are put together in the order of ``line_no``, a null one as an empty line; those
    with a null number or file are left out, as they have no place. ``begin_at`` counts
    characters. A broken record costs its own lines up to the next anchor, and a quoted
    field may span lines. Files are parsed in parts of ``part_lines`` line numbers, each
    together with the part after it, so that no task holds a whole file; a quoted field
    that isn't closed by then fails. As in the loader, a first reading makes sure that
    every part begins where the one before ends.
    """
    labels, spark = label_values(label_set), lines.sparkSession
    numbered = lines.where("file_name is not null and line_no is not null")
    rows = numbered.select("file_name", F.floor(F.col("line_no") / part_lines).alias("part"), "line_no", F.coalesce("line", F.lit("")).alias("line"))
    ordered = F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n")
    parts = stored(rows.groupBy("file_name", "part").agg(F.concat(ordered, F.lit("\n")).alias("own")))
    before = Window.partitionBy("file_name").orderBy("part")
    sizes = parts.select("file_name", "part", F.length("own").alias("size"))
    offsets = sizes.select(
        "file_name", "part", (F.sum("size").over(before) - F.col("size")).alias("begin"), F.sum("size").over(before).alias("end"),
        F.lead("part").over(before).alias("next"),
    )
    follow = parts.select("file_name", F.col("part").alias("next"), F.col("own").alias("rest"))
    texts = parts.join(offsets, ["file_name", "part"]).join(follow, ["file_name", "next"], "left")
    # the last line of a file has no line break of its own
    whole = F.when(F.col("next").isNull(), F.expr("left(own, length(own) - 1)")).otherwise(F.concat("own", "rest"))
    kept = stored(texts.select("file_name", "begin", "end", whole.alias("text")))
    name = T.StructField("file_name", T.StringType())

    def begun(row) -> tuple[Begun, int, int]:
        known = row.start is not None and row.start == row.start
        place = int(row.start) - row.begin if known else 0 if row.begin == 0 else Descent(row.text, labels).next_anchor(0)
        return begun_records(Lines(row.text), row.begin, place, row.end, len, labels)

    def ends(frames):
        import pandas as pd

        for row in (row for frame in frames for row in frame.itertuples(index=False)):
            _, first, after = begun(row)
            yield pd.DataFrame({"file_name": [row.file_name], "begin": [row.begin], "first": [first], "after": [after]})

    def parse(frames):
        import pandas as pd

        for row in (row for frame in frames for row in frame.itertuples(index=False)):
            found = [(row.file_name, at, *_row(x, place)) for at, place, x in begun(row)[0]]
            yield pd.DataFrame(found, columns=schema.names).astype({"error_field": "Int32", "error_at": "Int32"})

    schema = T.StructType([name, T.StructField("begin_at", T.LongType()), *PARSED])
    with_start = kept.withColumn("start", F.lit(None).cast("long"))
    if not kept.where("begin > 0").isEmpty() and (starts := settled_starts(spark, with_start, ends)):
        moved = spark.createDataFrame(starts, "file_name string, begin long, moved long")
        with_start = with_start.join(F.broadcast(moved), ["file_name", "begin"], "left").withColumn("start", F.col("moved"))
    return with_start.select("file_name", "begin", "end", "text", "start").mapInPandas(parse, schema)


def write_text_classification_tsv(df: DataFrame, path: str) -> None:
    """Write ``(texts, gold, noisy)`` so that the loader reads the same values back; nulls become empty."""

    def cell(name: str):
        value = F.coalesce(F.col(name), F.lit(""))
        quoted = F.concat(F.lit('"'), F.regexp_replace(value, '"', '""'), F.lit('"'))
        return F.when(value.rlike('[\t\r\n]|^"'), quoted).otherwise(value)

    df.select(F.concat_ws("\t", cell("texts"), cell("gold"), cell("noisy")).alias("value")).write.text(path)
