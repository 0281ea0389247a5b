"""Null, repeated and text identifiers, and null columns, in every text operator."""

import pytest
from pyspark.sql import functions as F

from tagsieve.llm import confusables, encode, format_copies, leaks, sentences, term_counts
from tagsieve.llm.queries import PATTERN

TEXT = "amber birch cedar dune ember fjord grove heath inlet jetty knoll"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(None, TEXT, None), (1, None, "a"), (1, TEXT, "a"), (2, TEXT.upper(), "a"), (None, TEXT, "a")], "id int, text string, noisy string")


def test_copies_with_null_ids(rows):
    found = format_copies.FormatCopies(rows, ["item"])
    assert [tuple(r) for r in found.pairs().collect()] == [(1, 2)]
    assert sum(r.copies for r in found.records().collect()) == 5


def test_row_operators_keep_null_ids(rows):
    assert confusables.consistent_forms(rows, "id", "text").where("id is null").count() == 2
    assert sentences.sentences(rows, "id").where("id is null").count() == 2
    items = rows.sparkSession.createDataFrame([(None, None, TEXT)], "item_id long, lang string, text string")
    found = leaks.leaked_passages(rows, items, "id").collect()
    assert sorted((r.id is None, r.item_id) for r in found if r.exact) == [(False, None)] * 2 + [(True, None)] * 2


def test_ids_may_be_text(rows):
    named = rows.select(F.concat(F.lit("x"), F.coalesce("id", F.lit(0))).alias("id"), "text", "noisy")
    assert {tuple(r) for r in format_copies.FormatCopies(named, ["item"]).pairs().collect()} >= {("x0", "x1"), ("x0", "x2")}
    assert sentences.sentences(named, "id").count() == 4


def test_small_vocabulary(rows, tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"am", b"ber", b"be"]
    path = tmp_path / "v"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    ids = [r.ids for r in encode.encode_corpus(rows, str(path), PATTERN, "id").collect()]
    assert len(ids) == 5 and ids[1] == [] and ids[0][:2] == [256, 257]


def test_term_records_must_be_integers(rows):
    with pytest.raises(ValueError):
        term_counts.term_counts(rows, {"noisy": F.col("noisy")}, "text")
    counts = term_counts.term_counts(rows, {"noisy": F.col("noisy")}, "id")
    assert [(r.occurrences, r.records) for r in counts.collect()] == [(4, 3)]
