import pytest

from tagsieve.llm.confusables import consistent_forms


def flags(alike, text):
    return {k for k, v in alike.inspect(text)[1].items() if v}


@pytest.mark.parametrize(
    "text,form,kinds",
    [
        ("plain text", "plain text", set()),
        ("tab\tand\r\nline", "tab\tand\r\nline", set()),
        ("Ｆｕｌｌ １２", "Full 12", {"compatibility"}),
        ("ﬁnal", "final", {"compatibility"}),
        ("café", "café", {"parts"}),
        ("йод", "йод", {"parts"}),
        ("라", "라", {"parts"}),
        ("zero​width", "zerowidth", {"invisible"}),
        ("soft­hyphen", "softhyphen", {"invisible"}),
        ("e​́", "é", {"invisible"}),
        ("no break", "no break", {"space"}),
        ("wide　space", "wide space", {"space"}),
        ("Nоrhаven", "Norhaven", {"mixed"}),
        ("Κöldmar", "Köldmar", {"mixed"}),
        ("Зapeльcк", "Зарельск", {"mixed"}),
        ("Ке́ldmar", "Kéldmar", {"mixed"}),
        ("Москва", "Москва", set()),
        ("Ἀθῆναι Θεός", "Ἀθῆναι Θεός", set()),
        ("x̂y", "x̂y", set()),
        ("Δt", "Δt", set()),
        ("東京タワーへ", "東京タワーへ", set()),
        ("“quote” – dash’s", "“quote” – dash’s", set()),
        ("", "", set()),
    ],
)
def test_forms(alike, text, form, kinds):
    assert alike.consistent_form(text) == form
    assert flags(alike, text) == kinds
    assert alike.consistent_form(form) == form


def test_script_sets(alike):
    assert alike.resolved_scripts("abc") == {"Latin"}
    assert alike.resolved_scripts("aб") == frozenset()
    assert "Jpan" in alike.resolved_scripts("漢カひ")
    assert alike.scripts_of("ー") >= {"Hiragana", "Katakana"} and "Jpan" in alike.resolved_scripts("スーパー")
    assert alike.readings("ёж")[0] == "single" and alike.readings("сор")[0] == "whole"


@pytest.mark.parametrize(
    "text,form",
    [("հello", "hello"), ("օne", "one"), ("ցoogle", "google"), ("Ꭺpple", "Apple"), ("Ᏼerlin", "Berlin"), ("Ρaris", "Paris"), ("աind", "wind"), ("ⲟld", "old"), ("pⲟtⲁtⲟ", None)],
)
def test_scripts_beyond_three(alike, text, form):
    found, kinds, _, _ = alike.inspect(text)
    assert form is None or found == form and kinds["mixed"]


def test_whole_script_confusables_keep_their_form_and_share_a_key(alike):
    form, kinds, whole, key = alike.inspect("сор 1")
    assert form == "сор 1" and not any(kinds.values()) and (whole, key) == (1, "cop 1")
    for text in ("сосо", "coco", "cоcо", "сосо\u200b"):
        assert alike.inspect(text)[3] == "coco"
    assert alike.inspect("Москва")[3] == "Москва" and alike.inspect("Νέα")[0] == "Νέα"
    assert alike.readings("аррӏе")[0] == alike.readings("сосо")[0] == "whole"


def test_context_decides_between_feasible_scripts(alike):
    assert alike.consistent_form("Привет сoр") == "Привет сор"
    assert alike.consistent_form("the cаp") == "the cap"


def test_all_pairs_look_alike_both_ways(alike):
    assert len(alike.like) > 500
    scripts = {s for own in alike.like.values() for s in own}
    assert {"Armenian", "Hebrew", "Arabic", "Georgian"} <= scripts and {"Cherokee", "Coptic"} <= {s for c in alike.like for s in alike.scripts_of(c)}
    for letter, own in alike.like.items():
        for script, other in own.items():
            assert script in alike.scripts_of(other) and script not in alike.scripts_of(letter)


def test_frame(spark):
    df = spark.createDataFrame([(1, "a​b", "x"), (2, None, "y"), (2, None, "y"), (3, "", None), (4, "Ａ" * 100_000, "z")], "id long, text string, form string")
    got = sorted((r.id, r.form, r.invisible) for r in consistent_forms(df, "id", "text").collect())
    assert got == [(1, "ab", True), (2, None, False), (2, None, False), (3, "", False), (4, "A" * 100_000, False)]
    assert consistent_forms(df.limit(0), "id", "text").count() == 0
