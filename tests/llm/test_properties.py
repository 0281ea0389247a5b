"""Properties of the text operators over generated texts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tagsieve.llm.leaks import words_of
from tagsieve.llm.sentences import sentence_spans

ODD = "abcNOpréА аоНеВсоαοΝβй́̈̆ＡｂC１ﬁ­​‍﻿ 　 \t\n라라漢カ'’-.!?…"
PUNCTUATED = "abAB1 .!?…\"'“”„«»()[]\n\r\t-•。！「」？、ก ข।؟;:,—éΩ #2"
texts = st.one_of(st.text(ODD, max_size=30), st.text(max_size=30))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_consistent_forms_are_fixed_points(alike, text):
    form, _, _, _ = alike.inspect(text)
    again, flags, _, _ = alike.inspect(form)
    assert again == form
    assert not any(flags.values())


@settings(max_examples=200, deadline=None)
@given(texts)
def test_unflagged_texts_stay(alike, text):
    form, flags, _, key = alike.inspect(text)
    assert any(flags.values()) or form == text
    assert alike.inspect(form)[3] == key


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdeOPнт", min_size=1, max_size=6), max_size=8))
def test_compared_words_ignore_case_space_and_marks(alike, words):
    plain = words_of(" ".join(words), alike)
    assert words_of(",\n ".join(f"*{w}*" for w in words), alike) == plain
    assert words_of("​ " + " ­".join(words), alike) == plain


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(PUNCTUATED, max_size=80), st.text(max_size=60)))
def test_sentences_part_the_text_without_loss(text):
    spans = sentence_spans(text)
    assert all(0 <= b < e <= len(text) and text[b:e] == text[b:e].strip() for b, e in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    rest, at = [], 0
    for b, e in spans:
        rest.append(text[at:b])
        at = e
    assert not "".join([*rest, text[at:]]).strip()
    assert all(not re.search(r"\n[ \t]*\n", text[b:e]) for b, e in spans)
