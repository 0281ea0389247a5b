import random

import pytest

import __spark_entry__
from tagsieve.sources import ranges, tsv

LABELS = ["a", "b"]


def why(line):
    found = tsv.parse_one(line, LABELS)
    return found.reason if isinstance(found, tsv.Broken) else (found.texts, found.gold, found.noisy)


@pytest.mark.parametrize(
    "line,expected",
    [
        ("t\ta\tb", ("t", "a", "b")),
        ("t\ta\tb\r", ("t", "a", "b")),
        ('"t\tu\nv"\ta\tb', ("t\tu\nv", "a", "b")),
        ('"say ""hi"""\ta\t"b"', ('say "hi"', "a", "b")),
        ('5" wide\ta\tb', ('5" wide', "a", "b")),
        (' "x"\ta\tb', (' "x"', "a", "b")),
        ("back\\tslash\ta\tb", ("back\\tslash", "a", "b")),
        ('"t\ta\tb', "quoting"),
        ('"t" \ta\tb', "quoting"),
        ('"t"x\ta\tb', "quoting"),
        ('t\ta\t"b', "quoting"),
        ('"""t""\ta\tb', "quoting"),
        ("t\ta", "columns"),
        ("t\ta\tb\t", "columns"),
        ("", "columns"),
        (None, "columns"),
        ("\r", "columns"),
        ("t\ta\tA", "value"),
        ("t\ta\tb\r\r", "value"),
        ("t\ta \tb", "value"),
        ("\ta\tb", "value"),
        ("  \ta\tb", "value"),
        ('""\ta\tb', "value"),
        ("t�\ta\tb", "value"),
        ("t\x00\ta\tb", "value"),
        ("x" * 1_000_000 + "\ta\tb", ("x" * 1_000_000, "a", "b")),
        ('"' + '""' * 100_000 + '"\ta\tb', ('"' * 100_000, "a", "b")),
    ],
)
def test_grammar(line, expected):
    assert why(line) == expected


def test_errors_are_located():
    assert tsv.parse_one('t\ta\t"b', LABELS).field == 2
    assert tsv.parse_one('t\ta\t"b', LABELS).at == 4
    assert tsv.parse_one("t\tno\tb", LABELS).at == 2
    assert tsv.parse_one("ab\x00\ta\tb", LABELS).at == 2


def test_recovery_resumes_at_the_next_valid_record():
    source = 'one\ta\ta\n"two\ta\tb\nthree\ta\tb\nfour\tx\tb\n"five\n5"\tb\tb\r\nsix\n'
    found = [(at, x.reason if isinstance(x, tsv.Broken) else x.texts) for at, x in tsv.Descent(source, LABELS).records()]
    assert [x for _, x in found] == ["one", "quoting", "three", "value", "five\n5", "columns"]
    assert all(source[at - 1] == "\n" for at, _ in found[1:])


def test_frame_keeps_every_row(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "idx int, label string")
    data = [(1, "t\ta\tb", "x"), (2, None, "y"), (2, None, "y"), (3, '"t', None)]
    lines = spark.createDataFrame(data, "line_id long, line string, reason string")
    parsed = tsv.parse_records(lines, labels)
    assert sorted((r.line_id, r.reason) for r in parsed.collect() if r.reason) == [(2, "columns"), (2, "columns"), (3, "quoting")]
    assert [tuple(r) for r in tsv.valid_records(parsed).collect()] == [(1, "t", "a", "b")]
    assert tsv.failed_records(parsed).count() == 3
    assert tsv.parse_records(lines.limit(0), labels).count() == 0


def test_written_files_read_back(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice('ab "\t\n\\é') for _ in range(rng.randint(1, 12))) + "x" for _ in range(60)]
    df = spark.createDataFrame([(t, rng.choice(LABELS), rng.choice(LABELS)) for t in texts], "texts string, gold string, noisy string")
    tsv.write_text_classification_tsv(df, str(tmp_path / "out"))
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, label string")
    back = tsv.load_text_classification_tsv(spark, str(tmp_path / "out"), labels)
    assert back.where("reason is not null").count() == 0
    assert sorted(map(tuple, back.select("texts", "gold", "noisy").collect())) == sorted(map(tuple, df.collect()))


def test_files_by_line(spark, tmp_path):
    (tmp_path / "f.tsv").write_bytes(b't\ta\tb\r\n"open\ta\tb\n\nu\tb\tb')
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, label string")
    rows = tsv.load_text_classification_tsv(spark, str(tmp_path / "f.tsv"), labels, multiline=False).collect()
    assert sorted((r.texts or "", r.reason or "") for r in rows) == [("", "columns"), ("", "quoting"), ("t", ""), ("u", "")]
    whole = tsv.load_text_classification_tsv(spark, str(tmp_path / "f.tsv"), labels).collect()
    assert sorted((r.texts or "", r.reason or "") for r in whole) == [("", "quoting"), ("t", ""), ("u", "")]


def odd_source(rng, size):
    """Lines of valid, broken and many-line records; some lines within quoted fields look like records."""
    parts = []
    for _ in range(size):
        kind = rng.randrange(8)
        word = "".join(rng.choice("xyzé漢") for _ in range(rng.randint(1, 9)))
        parts.append(
            [f"{word}\ta\tb", f"{word}\ta\tb\r", f'"{word}\n{word}"\tb\ta', f'"{word}\nin\ta\tb\n{word}"\tb\ta', f'"{word}\ta\tb', f"{word}\tb", f"{word}\tno\ta", f'"{word}"" \tq"\ta\ta'][kind]
        )
    return "\n".join(parts) + rng.choice(["", "\n"])


def test_ranges_read_as_whole_files(spark, tmp_path):
    rng = random.Random(8)
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, label string")
    (tmp_path / "in").mkdir()
    expected = []
    for k in range(3):
        source = odd_source(rng, [60, 5, 0][k])
        raw = source.encode()
        if k == 1:
            raw = b"bad \xff\ta\tb\n" + raw
        (tmp_path / f"in/f {k}.tsv").write_bytes(raw)
        text = raw.decode("utf-8", "surrogateescape")
        for at, x in tsv.Descent(text, LABELS).records():
            expected.append((k, len(text[:at].encode("utf-8", "surrogateescape")), x.reason if isinstance(x, tsv.Broken) else x.texts, x.at - at if isinstance(x, tsv.Broken) else None))
    for size in (1 << 20, 97, 23):
        found = tsv.load_text_classification_tsv(spark, str(tmp_path / "in"), labels, range_bytes=size).collect()
        assert sorted((int(r.file_name[-5]), r.begin_at, r.reason or r.texts, r.error_at) for r in found) == sorted(expected, key=lambda x: x[:2]), size


def test_parts_of_lines_read_as_whole_files(spark):
    rng = random.Random(6)
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, label string")
    sources = {f"f{k}": odd_source(rng, size).rstrip("\n") for k, size in enumerate((70, 30, 1))}
    rows = [(name, k + 1, line) for name, source in sources.items() for k, line in enumerate(source.split("\n"))]
    lines = spark.createDataFrame([*rows, (None, 1, "x"), ("f1", None, "y")], "file_name string, line_no int, line string").repartition(5)
    expected = {}
    for name, source in sources.items():
        for at, x in tsv.Descent(source, LABELS).records():
            expected[name, at] = (x.reason, x.at - at) if isinstance(x, tsv.Broken) else (x.texts, None)
    for size in (20_000, 40, 25):
        found = tsv.parse_lines_by_file(lines, labels, size).collect()
        assert {(r.file_name, r.begin_at): (r.reason or r.texts, r.error_at) for r in found} == expected, size
        assert len(found) == len(expected)


def test_range_text_reads_on_as_asked(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "MORE_BYTES", 1)
    raw = "aé漢𝔸b\n".encode() * 5 + b"\xe6"
    (tmp_path / "f").write_bytes(raw)
    for begin in range(len(raw)):
        text = ranges.RangeText(f"file:{tmp_path}/f", begin, begin + 1, len(raw))
        while not text.whole:
            text.more()
        assert text.text.encode("utf-8", "surrogateescape") == raw[begin:]


def test_known_starts_equal_single_records():
    rng = random.Random(2)
    lines = [odd_source(rng, rng.randint(0, 2)) for _ in range(200)] + [None, "", "\r", '"', "t\ta\tb"]
    rng.shuffle(lines)
    assert tsv.parse_known(lines, LABELS) == [tsv.parse_one(line, LABELS) for line in lines]
    assert tsv.parse_known([], LABELS) == []


def test_unbounded_label_sets_are_refused(spark):
    with pytest.raises(ValueError):
        tsv.label_values(spark.range(20).selectExpr("cast(id as string) as label"), limit=10)


def test_query_recovers_within_files(spark, tmp_path):
    lines = ["t\ta\tb", '"open\ta\tb', "lost", "u\tb\tb", '"two', 'lines"\ta\ta', None, "v\ta"]
    rows = [(k, name, k, x) for name in ("f", "g") for k, x in enumerate(lines)]
    spark.createDataFrame(rows[::-1], "line_id long, file_name string, line_no int, line string").write.parquet(str(tmp_path / "raw_lines.parquet"))
    spark.createDataFrame([(0, "a"), (1, "b")], "idx int, label string").write.parquet(str(tmp_path / "label_set.parquet"))
    found = __spark_entry__.queries()["p5_recovered"](spark, str(tmp_path)).orderBy("file_name", "begin_at").collect()
    whole = [("t", None), (None, "quoting"), ("u", None), ("two\nlines", None), (None, "columns"), (None, "columns")]
    assert [(r.file_name, r.texts, r.reason) for r in found] == [(name, *x) for name in ("f", "g") for x in whole]
