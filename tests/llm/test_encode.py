import base64
import os
import random

import pytest

from tagsieve.llm import encode
from tagsieve.llm.queries import PATTERN, VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")
TEXTS = ["", None, "Hello  world's\n\n test", "naïve 東京 ไทย कि 👍🏽", "<|endoftext|>", " \t ", "a" * 3_000, "xyzzyqwrt" * 500, "\u0000�", "é"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    with open(VOCABULARY, "rb") as file:
        return encode.Vocabulary.parse(file.read(), PATTERN)


def test_hash_is_minimal_and_perfect(vocabulary):
    keys = list(vocabulary.ranks)
    places = vocabulary.hash.places(keys)
    assert sorted(places.tolist()) == list(range(len(keys)))
    few = [b"a", b"b", b""]
    assert sorted(encode.PerfectHash(few).places(few).tolist()) == [0, 1, 2]


def test_ids_equal_the_public_library(vocabulary, reference):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abcdeXYZ 0189.,'’éß日本語กข😀\n") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    assert vocabulary.encode(texts) == [reference.encode_ordinary(t) if t else [] for t in texts]


def test_ids_decode_to_the_text(vocabulary, reference):
    for text, ids in zip(TEXTS, vocabulary.encode(TEXTS)):
        assert reference.decode(ids) == (text or "")


def test_frame(spark, reference):
    data = [(i, t, "x") for i, t in enumerate(TEXTS + TEXTS)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df, VOCABULARY, PATTERN).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t, _ in data}
    assert encode.encode_corpus(df.limit(0), VOCABULARY, PATTERN).count() == 0
