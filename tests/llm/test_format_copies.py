import random

import numpy as np
import pytest

from tagsieve.llm import format_copies as fc

NAMES = ["item", "place", "count"]


def found(df, **options):
    copies = fc.FormatCopies(df, NAMES, **options)
    return sorted(map(tuple, copies.pairs().collect())), sorted(map(tuple, copies.records().collect()))


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, n, "x") for i, t, n in rows], "id long, text string, noisy string, digest string")

    return make


def test_formatting_does_not_count_but_accents_and_labels_do(frame):
    rows = [
        (1, "A café, really!", "yes"), (2, "a CAFÉ really", '"Yes"'), (3, "a cafe really", "yes"), (4, "A café, really!", "no"),
        (5, "a  ca-fé\nreally", " yes."), (6, None, "yes"), (7, None, "yes"), (8, "", "yes"), (9, "...", "yes"), (10, "a café really", None), (11, "A café really", None),
    ]
    pairs, records = found(frame(rows))
    assert pairs == [(1, 2), (1, 5), (8, 9), (10, 11)]
    assert dict(records) == {1: 3, 3: 1, 4: 1, 6: 1, 7: 1, 8: 2, 10: 2}


def test_named_fields_in_any_order_and_notation(frame):
    rows = [
        (1, "item: Xu | place: Rome | count: 5", "a"), (2, '{"count": "5", "item": "XU", "place": "rome"}', "a"), (3, "[Place] Rome.  |[item] Xu  |[count] 5 ", "a"),
        (4, "place= Rome; count= 5; item= Xu", "a"), (5, "COUNT - 5, ITEM - Xu, PLACE - Rome", "a"), (6, "count: 5\nitem: Xu\nplace: Rome", "a"),
        (7, "item: Rome | place: Xu | count: 5", "a"), (8, "item: Xu | place: Rome", "a"), (9, "item: Xu | place: Rome | count: 55", "a"),
    ]
    assert found(frame(rows))[0] == [(1, k) for k in range(2, 7)]


def test_order_counts_outside_fields(frame):
    assert found(frame([(1, "big red", "a"), (2, "red big", "a"), (3, "the item: big", "a"), (4, "big the item:", "a")]))[0] == []


def test_empty_table_and_repeated_ids(frame):
    assert found(frame([])) == ([], [])
    pairs, records = found(frame([(1, "x y", "a"), (1, "x, y", "a"), (2, "X Y", "a")]))
    assert pairs == [(1, 2)] and records == [(1, 3)]


def test_hot_group_long_texts_and_several_passes(frame):
    rng = random.Random(0)
    texts = ["same text"] * 300 + [f"text {rng.random()}" for _ in range(600)] + ["y" * 200_000] * 2
    rows = [(i, t.upper() if i % 2 else t, "a") for i, t in enumerate(texts)]
    pairs, records = found(frame(rows))
    assert pairs == [(0, i) for i in range(1, 300)] + [(900, 901)]
    assert sum(n for _, n in records) == len(rows)
    assert fc.Layout.of(100_000, fc.SEGMENT_BYTES * 3).passes == 5


def test_passes_do_not_change_the_result(frame, monkeypatch):
    monkeypatch.setattr(fc, "BITS_PER_RECORD", 4_000)
    rows = [(i, f"t {i % 70}", "a") for i in range(100)]
    expected = [(i - 70, i) for i in range(70, 100)]
    assert fc.Layout.of(100, fc.SEGMENT_BYTES * 2).passes == 4
    assert found(frame(rows), max_filter_bytes=fc.SEGMENT_BYTES * 2)[0] == expected


@pytest.mark.parametrize("passes,folders", [(1, 64), (40, 64), (40, 5)])
def test_many_passes_in_own_or_shared_folders(frame, monkeypatch, passes, folders):
    monkeypatch.setattr(fc, "FOLDERS", folders)
    monkeypatch.setattr(fc, "BITS_PER_RECORD", fc.SEGMENT_BITS // 3)
    rng = random.Random(passes)
    keys = [rng.randrange(80) for _ in range(120)]
    rows = [(i, f"Text no {k}" if i % 2 else f"text, NO {k}", "a") for i, k in enumerate(keys)]
    least = fc.SEGMENT_BYTES * (40 // passes)
    assert fc.Layout.of(120, least).passes == passes
    pairs, records = found(frame(rows), max_filter_bytes=least)
    assert pairs == sorted((keys.index(k), i) for i, k in enumerate(keys) if keys.index(k) < i)
    assert dict(records) == {keys.index(k): keys.count(k) for k in set(keys)}


def test_filters_never_miss_a_repeat():
    rng = np.random.default_rng(1)
    layout = fc.Layout.of(4_000)
    hashes = rng.integers(-(1 << 62), 1 << 62, 4_000)
    parts = [hashes[:2_000], np.r_[hashes[1_990:3_000], hashes[2_500:2_510]], hashes[2_990:]]
    size = layout.per_pass * fc.SEGMENT_BYTES
    once, again = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    for part in parts:
        o, a = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in np.array_split(part, 7):
            fc.add_hashes(o, a, batch, layout, 0)
        fc.merge(once, again, o, a)
    held = fc.has_bits(again, layout.bits(hashes, 0))
    repeated = np.zeros(4_000, bool)
    repeated[1_990:2_000] = repeated[2_500:2_510] = repeated[2_990:3_000] = True
    assert held[repeated].all()
    assert held[~repeated].mean() < 0.05
