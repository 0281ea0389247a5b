import random

import pytest

from tagsieve.sources import conll


@pytest.mark.parametrize("size", [1 << 20, 50, 7, 1])
def test_ranges_number_sentences_as_whole_files(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(conll, "BACK_BYTES", 40)
    rng = random.Random(1)
    expected = set()
    for k in range(2):
        parts, number = [], 0
        for _ in range(12):
            lines = []
            for pos in range(rng.randint(1, 4)):
                word = "".join(rng.choice("aé漢") for _ in range(rng.randint(1, 5)))
                fields = [word, "X", "Y", "more"][: rng.choice([1, 3, 3, 3, 4])]
                lines.append("\t".join(fields))
                expected.add((k, number, pos, *(fields + [None, None])[:3]))
            parts.append(rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["\n\n", "\r\n \t\r\n", "\n\n\n \n"]))
            number += 1
        (tmp_path / f"f{k}.conll").write_bytes((rng.choice(["", " \n\n"]) + "".join(parts)).encode())
    (tmp_path / "f9.conll").write_bytes(b"")
    rows = conll.read_conll(spark, str(tmp_path), range_bytes=size).collect()
    assert {(int(r.file_name[-7]), r.sent_no, r.pos, r.token, r.gold, r.noisy) for r in rows} == expected and len(rows) == len(expected)
