import random

import pytest

from tagsieve.llm.sentences import MOST_GAINED, Lexicon, best_spans, candidates, divide, learnt_words, sentence_spans, sentences, span_score


def split(text):
    return [text[b:e] for b, e in sentence_spans(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Vastor met J. R. Tolmen at 9 a.m. sharp.", "They left."],
        ["It ended at 4 p.m.", "We ate fruit, nuts, etc.", "No. 5 was never opened."],
        ["Values, e.g. 0.5 vs. 0.7, rose from 3.1 to 4.2.", "Really?!", "Yes."],
        ['"Is that one?" asked Kilor.', '"Wrong!" Maya said loudly.', "The end."],
        ['He said, "It is late."', "Then came 4 ... and more."],
        ["(This was also true.)", "See p. 12 (cf. Sec. 3) for more!"],
        ["Der 3. Durchgang begann am 8. Mai.", "Von 353 Zeilen fehlten 174.", "„Das ist falsch.“", "Viele Fälle, z. B. Orte, blieben."],
        ["M. Vastor voit la fig. 3.", "« C'est une erreur. »", "« Vraiment ? » demanda Luc.", "Quelle surprise !"],
        ["¿Por qué salió?", "¡Así no!", "«¿Es uno?», preguntó Ana.", "El Sr. Vastor vio la pág. 4."],
        ["И. О. Ильмар живёт в г. Зарельск.", "«Это он?» — спросил Пётр.", "Ну... второй всё же ушёл."],
        ["Γιατί έλεγξε τη γραμμή 266;", "Βλ. εικ. 3.", "«Είναι ένα;» ρώτησε ο κ. Βάστορ."],
    ],
)
def test_spaced_scripts(parts):
    assert split(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["一致率从0.40升到0.78。", "“标签错了。”", "他想了想……还是跳过了。", "真的吗？！", "Kim问：“是吗？”然后走了。"],
        ["「これは一つですか？」とKimが聞いた。", "「もう一度見よう。」", "それは違う！"],
    ],
)
def test_scripts_without_spaces(parts):
    assert split("".join(parts)) == parts


def test_thai_devanagari_and_arabic():
    thai = ["ป้ายของ Zohis ยังไม่ถูกข้ามก่อนเที่ยง", "ข้อมูลชุด Gabanal มี 121 แถวที่ต้องรวม"]
    assert split(" ".join(thai)) == thai
    hindi = ["डॉ. वस्तोर ने पंक्ति 126 ठीक किया।", "“क्या यह है?” Kim ने पूछा।", "ऐसा नहीं!"]
    assert split(" ".join(hindi)) == hindi
    arabic = ["ارتفعت النسبة من 0.2 إلى 0.4.", "«هل هذا مقطع؟» سأل Kim.", "لماذا تجاوز د. فاستور السطر 3؟"]
    assert split(" ".join(arabic)) == arabic


def test_blocks_lists_headings_and_wrapped_lines():
    text = "  Notes on it\n\nOne line\nwrapped here. Next one.\r\n \r\n- first item\n- second item. With more\n\n1. ask\n2. tell\n\n\tlast without mark \n"
    assert split(text) == ["Notes on it", "One line\nwrapped here.", "Next one.", "- first item", "- second item. With more", "1. ask", "2. tell", "last without mark"]


def test_spans_are_ordered_trimmed_and_cover_all_text():
    text = 'A "b. c. (d! Eee? «F... g” h.\n\n) ] x: 5" 7. Zz. \u200b Y'
    spans = sentence_spans(text)
    assert all(text[b:e] == text[b:e].strip() and b < e for b, e in spans)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert "".join(text[b:e] for b, e in spans).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_blank_texts():
    assert split("") == split(None) == split(" \n\t\r\n ") == []


def test_very_long_texts_in_reasonable_time():
    assert len(split("A short sentence stands here. " * 20_000)) == 20_000
    assert len(split("no end at all " * 50_000)) == 1
    assert len(split("all lower. no case. " * 20_000)) == 1
    assert len(split('"Never closed. ' + "Row 1. 2 more. " * 10_000)) > 10_000


def test_frame(spark):
    df = spark.createDataFrame([(1, "One. Two.", 0), (1, "One. Two.", 0), (2, None, 0), (3, "  ", 0)], "doc_id long, text string, begin_at int")
    assert sorted(map(tuple, sentences(df, with_text=True).collect())) == [(1, 0, 4, "One."), (1, 0, 4, "One."), (1, 5, 9, "Two."), (1, 5, 9, "Two.")]
    assert sentences(df.limit(0)).count() == 0


def searched_whole(text):
    """The best spans of a block by trying every span."""
    places = [p for p in candidates(text) if p[2] > -MOST_GAINED]
    starts, ends = [0] + [p[1] for p in places], [p[0] for p in places] + [len(text)]
    state, weight = [()] + [p[3] for p in places] + [()], [p[2] for p in places] + [0.0]
    best = [(0.0, [])]
    for j in range(1, len(ends) + 1):
        tried = [(best[i][0] + weight[j - 1] + span_score(text, starts[i], ends[j - 1], state[i] == state[j]), -i) for i in range(j)]
        score, i = max(tried)
        best.append((score, [*best[-i][1], (starts[-i], ends[j - 1])]))
    return best[-1][1]


def test_detached_marks_are_no_sentences():
    assert split("Wait . . . Then he left.") == ["Wait . . .", "Then he left."]
    assert split("He left ? ! Then it rained.") == ["He left ? !", "Then it rained."]


@pytest.mark.parametrize("marks", ["“”", '""', "«»", "()", "„“", "「」"])
@pytest.mark.parametrize("size", [1, 2, 4, 40, 400])
def test_a_quotation_within_a_sentence_does_not_end_it(marks, size):
    inner = " ".join(["One day came.", "Two days went."][k % 2] for k in range(size))
    text = f"He said, {marks[0]}{inner}{marks[1]} and then he left the room. It rained."
    assert split(text) == [text[: -len(" It rained.")], "It rained."]
    assert split(f"{marks[0]}{inner[:-1]},{marks[1]} he said. It rained.")[1:] == ["It rained."]


def test_a_long_quotation_of_its_own_is_divided():
    assert len(split("It rained. “" + " ".join(["Then the day came."] * 30) + "” It snowed.")) == 32


def test_marks_of_inches_and_lost_quotation_marks_hide_nothing():
    assert split('The 5" tube. It broke. The 6" tube. Done.') == ['The 5" tube.', "It broke.", 'The 6" tube.', "Done."]
    assert split('He said "no. It rained all day. Then it snowed. "Yes," he said.')[-1] == '"Yes," he said.'


@pytest.mark.parametrize(
    "parts",
    [
        ["The U.S. Army arrived.", "They came from the U.S.", "He saw Cmdr. Jones and Supt. Brown."],
        ["To było na ul. Długa.", "Ze av. Brasil.", "De heer drs. Jansen kwam."],
        ["Это было в 2000 г.", "Он ушёл в г. Зарельск."],
        ["It ran 5 km.", "Then it stopped.", "It speaks HTTP.", "It works."],
    ],
)
def test_abbreviations(parts):
    assert split(" ".join(parts)) == parts


def test_plain_blocks_need_no_program():
    rng = random.Random(9)
    pieces = ["It is late", "then", "he left them", "No", "Row 5", ".", ".", "!", "...", "Dr.", "x" * 450]
    for _ in range(300):
        text = " ".join(rng.choices(pieces, k=rng.randint(3, 40))).strip()
        places = [p for p in candidates(text) if p[2] > -MOST_GAINED]
        if places:
            args = [0] + [p[1] for p in places], [p[0] for p in places] + [len(text)], [p[2] for p in places] + [0.0], [()] * (len(places) + 2)
            assert divide(text) == best_spans(text, *args), text


def test_program_is_searched_whole():
    rng = random.Random(4)
    pieces = ["Wait", "then", "he left", "I", "Ok", ".", "?", "!", "...", " . ", '"', "(", ")", "Dr.", "3.", "x" * 450]
    texts = [" ".join(rng.choices(pieces, k=rng.randint(3, 60))).strip() for _ in range(150)]
    for text in [*texts, 'He said "' + "No! " * 250 + '" and left. Then it rained.']:
        assert divide(text) == searched_whole(text), text


def test_words_are_learnt_from_the_corpus(spark):
    rng = random.Random(3)
    names, rows = ["Abel", "Bora", "Cem"], []
    for k in range(300):
        sect = rng.choice(["the work of art. It stood there.", "art in the hall was seen.", "new art, old art and art of all times"])
        rows.append((k, f"We met qlo. {rng.choice(names)} at the door zub. 5 that day. He said yup. They saw {sect}\n\nIt was yup."))
    df = spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, "  ")], "doc_id long, text string")
    found = learnt_words(df)
    assert found == learnt_words(df.repartition(7)) == Lexicon(frozenset({"qlo", "zub"}), frozenset())
    assert learnt_words(df.limit(0)) == Lexicon()
    text = "We met qlo. Abel there. It was yup. They left."
    assert len(sentence_spans(text)) == 4 and len(sentence_spans(text, found)) == 3
    at_end = spark.createDataFrame([(k, "He saw old art here and art there.\n\nHe loves art. So do art lovers.\n\nHe saw art.") for k in range(40)], df.schema)
    learnt = learnt_words(at_end)
    assert learnt.ordinary == {"art"} and [len(sentence_spans("He loves art. So do we.", x)) for x in (Lexicon(), learnt)] == [1, 2]
    assert sentences(df.where("doc_id >= 0")).count() == sentences(df).count()
