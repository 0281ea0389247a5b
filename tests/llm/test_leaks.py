import random
import time

import pytest

from tagsieve.llm import leaks

WORDS = "amber birch cedar dune ember fjord grove heath inlet jetty knoll lagoon meadow north ocean prairie quarry ridge slope tundra".split()
ZH = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜"


@pytest.fixture
def items(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(WORDS, k=25)) for _ in range(12)]
    rows = [(k, "en", t) for k, t in enumerate(texts)] + [(50, "zh", ZH), (51, "en", "too short to leak"), (52, "en", None), (53, None, "")]
    return texts, spark.createDataFrame(rows, "item_id long, lang string, text string")


def exact(df, items, **options):
    return {(r.doc_id, r.item_id) for r in leaks.leaked_passages(df, items, **options).collect() if r.exact}


def test_disguised_partial_and_near_passages(spark, items):
    texts, frame = items
    words = texts[0].split()
    docs = [
        (1, "before it " + " ".join(words[3:13]) + " after"),
        (2, "before it " + " ".join(words[3:12]) + " after"),
        (3, " ".join(words[3:13]).upper().replace(" ", ",\n")),
        (4, " ".join(f"**{w}**" for w in words[3:13])),
        (5, " ".join(w.replace("o", "о").replace("e", "e​") for w in words)),
        (6, " ".join(words[:6] + ["XXXX"] + words[7:16] + ["YYYY"] + words[17:])),
        (7, None), (8, ""), (9, texts[1] + "\n\n" + texts[2]), (9, texts[1] + "\n\n" + texts[2]),
        (10, "前言" + ZH[5:25] + "后语"), (11, "前言" + ZH[5:24] + "后语"), (12, ZH[:12] + "，\n" + ZH[12:30]),
        (13, "<b>" + "</b> &amp; <i>".join(words[8:20]) + "</i>"),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    expected = {(1, 0), (3, 0), (4, 0), (5, 0), (9, 1), (9, 2), (10, 50), (12, 50), (13, 0)}
    assert exact(df, frame) == expected
    assert exact(df, frame, block_characters=150) == expected
    kept = {(r.doc_id, r.item_id) for r in leaks.leaked_passages(df, frame).collect()}
    assert expected <= kept
    assert leaks.leaked_passages(df, frame).where("doc_id = 9 and exact").count() == 4


def test_empty_tables(spark, items):
    _, frame = items
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert leaks.leaked_passages(df.limit(0), frame).count() == 0
    assert leaks.leaked_passages(df, frame.limit(0)).count() == 0


def test_equal_to_brute_force_on_random_mixtures():
    rng = random.Random(9)
    pool = WORDS[:7]
    items = [leaks.Item(k, rng.choices(pool, k=18), False) for k in range(15)]
    index = leaks.Index(items)
    docs = []
    for _ in range(120):
        words = rng.choices(pool, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            source = rng.choice(items).words
            begin, at = rng.randint(0, 10), rng.randint(0, len(words))
            words[at:at] = source[begin : begin + rng.randint(6, 14)]
        docs.append(words)
    expected = set()
    for d, words in enumerate(docs):
        windows = {tuple(words[k : k + 10]) for k in range(len(words) - 9)}
        expected |= {(d, i.item_id) for i in items if windows & i.windows()}
    assert {(d, i) for d, i, _, hit in index.leaks(docs) if hit} == expected
    assert expected


def test_very_long_document(items, alike):
    texts, _ = items
    index = leaks.Index([leaks.Item(0, leaks.words_of(texts[0], alike), False)])
    filler = ["filler"] * 200_000
    assert [x[3] for x in index.leaks([filler + leaks.words_of(texts[0], alike)[2:14] + filler])] == [True]


def test_repeated_grams_in_parts(monkeypatch):
    monkeypatch.setattr(leaks, "HITS_AT_ONCE", 100)
    monkeypatch.setattr(leaks, "BANDS_AT_ONCE", 3)
    index = leaks.Index([leaks.Item(0, ["aa"] * 30, False), leaks.Item(1, ["ab"] * 30, False)])
    found = index.leaks([["aa"] * 200, ["ab"] * 12, ["ba"] * 50, ["aa"] * 9])
    assert {(d, i) for d, i, _, exact in found if exact} == {(0, 0), (1, 1)}


def test_long_tags_are_taken_out_and_text_between_brackets_is_not(alike):
    long = " ".join(WORDS * 4)
    for attributes in (f'href="x" hidden title="{long}"', f"id=a title = '{long}' /", f"href={long.replace(' ', '/')}"):
        assert leaks.words_of(f"amber <a {attributes}>birch</a> cedar", alike) == ["amber", "birch", "cedar"]
    assert leaks.words_of(f"a <b and {long}, c> d", alike) == ["a", "b", "and", *long.split(), "c", "d"]


def test_a_long_item_costs_others_nothing():
    rng = random.Random(5)
    short = [leaks.Item(k, rng.choices(WORDS, k=18), False) for k in range(300)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    long = leaks.Item(900, ["".join(rng.choices(letters, k=6)) for _ in range(50_000)], False)
    docs = [rng.choices(WORDS, k=20) + item.words[2:15] for item in short[:40]]

    def seconds(items):
        index = leaks.Index(items)
        began = time.process_time()
        found = index.leaks(docs)
        return time.process_time() - began, found

    alone, found = min(seconds(short) for _ in range(3))
    beside, also = min(seconds([*short, long]) for _ in range(3))
    assert sorted(also) == sorted(found) and beside < 2 * alone + 0.2
    index = leaks.Index([*short, long])
    assert [(i, e) for _, i, _, e in index.leaks([long.words[40_000:40_012], long.words[-11:], long.words[:9]])] == [(900, True), (900, True), (900, False)]


def edited(rng, text, edits):
    text = list(text)
    for at in sorted(rng.sample(range(5, len(text) - 5), edits), reverse=True):
        kind = rng.randrange(3)
        text[at : at + (kind != 0)] = [rng.choice("xyz")] if kind != 1 else []
    return "".join(text)


def longest_alike(text, item, edits):
    """The best local alignment score by the whole matrix, one row at a time."""
    best, row = 0, [0] * (len(item) + 1)
    for c in text:
        new = [0]
        for j, d in enumerate(item, 1):
            new.append(max(0, row[j - 1] + (1 if c == d else -leaks.EDIT_COST), row[j] - leaks.EDIT_COST, new[j - 1] - leaks.EDIT_COST))
            best = max(best, new[j])
        row = new
    return best


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_recall_of_passages_with_edits(edits):
    """Every document whose best alignment reaches an item's score is found; the whole matrix is the brute force."""
    rng = random.Random(edits)
    items = [leaks.Item(k, rng.choices(WORDS, k=16), False) for k in range(12)]
    index = leaks.Index(items)
    docs = []
    for k in range(36):
        source = "".join(items[k % 12].words[2:14])
        docs.append(["".join(rng.choices(WORDS, k=4)), edited(rng, source, edits), "".join(rng.choices(WORDS, k=4))])
    found = {(d, i) for d, i, _, _ in index.leaks(docs)}
    wanted = {(d, i.item_id) for d, words in enumerate(docs) for k, i in enumerate(index.items) if longest_alike("".join(words), i.text, edits) >= index.score[k]}
    planted = {(d, d % 12) for d in range(36)}
    assert planted & wanted <= found and len(planted & wanted) >= 30
    assert len(wanted & found) >= 0.9 * len(wanted)


def test_blocks_share_one_reading(spark, items):
    texts, frame = items
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    several = leaks.leaked_passages(df, frame, block_characters=150)
    assert str(several._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == -(-13 // leaks.BLOCKS_AT_ONCE)
    assert {(r.doc_id, r.item_id) for r in several.collect() if r.exact} == {(k, k) for k in range(12)}
