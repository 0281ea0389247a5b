"""Sentence spans of texts in any language and script.

Blank lines, list items and marked headings part a text into blocks. Within a block every
place where a sentence could end is a candidate, and a semi-Markov dynamic program picks the
sequence of whole spans between candidates with the highest total score. A span's score
joins the word and mark that close it, the words that open it, whether its quotations and
brackets are balanced, and its length. A quotation that is part of a larger sentence, as
what stands before or after it goes on, holds no candidates, however long it is. No language
label is read: the script and the words themselves decide.

Which short words are abbreviations is learnt from the whole corpus, besides fixed lists: an
abbreviation nearly always has its point, often goes on with a small letter or a number, and
doesn't end paragraphs as the last words of sentences do.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsieve.plans.runtime import checkpoint

# Words whose final point is part of an abbreviation that a name, number or
# further word follows.
NEVER_FINAL = frozenset(
    """
    abb abs abt adj adm approx aprox apt art assoc ave bd betr bl bzgl bzw ca cap capt cf chap
    chs col comp cpt dept dipl dir doc dr dra ed eds ej engl est et ex exc fam fig figs fr frl
    geb gen ges gez gov hon hr hrn incl ing inkl kap lic lieut lt maj max mgr min mio mlle mm
    mme mr mrs ms mt mtro nos nr núm num obs op pag pág pags pp pres prof prov ps publ ref reg
    rep resp rev sec sect sen sgt sig sog sr sra srta st ste str tab tel trad univ vgl vol vols
    vs zzt env cit éd pers rel subst sup ver vid al ital dto cía supt cmdr drs av avda ul pl os l'on
    гл гр др им кв корп мин напр обл оз пер пл пос проф рис род руб см ср ст стр табл тел тыс ул
    акад доц млн млрд п.п
    βλ εικ κα κος σελ αρ τηλ κεφ δρ καθ πρβλ
    डॉ प्रो श्री पं सं कु
    """.split()
)
# Abbreviations that may also end a sentence.
MAY_END = frozenset("etc usw usf inc ltd co corp bros jr a.m p.m am pm ff b.c a.d κλπ κ.λπ κ.ά т.д т.п пр uds ud vd vds cie".split())
# Abbreviations that end a sentence only before a word that often opens one.
BEFORE_NAMES = frozenset("u.s u.k e.u d.c u.n u.s.a".split())
# Abbreviations that may end a sentence after a number only.
AFTER_NUMBER = frozenset("г гг в вв".split())
# Short names of months and days, which a day or a time follows.
CALENDAR = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun ene abr ago dic janv févr avr juil déc okt dez янв февр апр авг сент окт нояб дек".split())
# Words after which a number with a point is an ordinal.
BEFORE_ORDINAL = frozenset("am ab beim bis das dem den der des die im jeden jeder jedes nach seit vom vor zum zur dritten".split())
# Words that often open a sentence.
OPENERS = frozenset(
    """
    a an all and but he how i if in it no on our she so that the then there these they this those we what when where
    which who why you aber als das der die ein eine er es ich ihr im in man nach sie so und von was wenn wer wie wir
    à c'est ce certains ces cette dans elle en et il ils je l la le les mais nous on où pour pourquoi quand un une vous
    al algunos como cuando de donde el ella ellos en esta este la las los no para pero por que qué se si un una y
    в во где для и из к как когда мы на не но он она они по почему с так что это я
    γιατί δεν η και μα με ο οι όταν πού πώς στη στο τα τη την της τι το τον του
    """.split()
)
# Verbs that name the speaker after a quotation.
SPEECH = "asked|said|wrote|replied|answered|added|noted|shouted|cried|whispered|explained|argued|warned|says|asks|writes|thought|insisted|remarked"
SPEAKER = regex.compile(rf"(?:\p{{Lu}}[\p{{L}}\p{{M}}.'’-]*\s+){{1,3}}(?:{SPEECH})\b")
SPEAKER_HINDI = regex.compile(r"(?:[\p{L}\p{M}.]+\s+){1,3}ने\s+(?:पूछा|कहा|लिखा|बताया|जवाब|उत्तर|सोचा|बोला)")
SPEAKER_OTHER = regex.compile(r"(?:سأل|سألت|قال|قالت|كتب|كتبت|أجاب|أجابت|أضاف|أضافت|ردّ?|ردت)(?![\p{L}\p{M}])|(?:と|って|という|との|とか|な[んの]て|然后|就|便|却|并|而|的|地|说|問|问|道|答|喊|写)")

#: Points of the score: for each span end, span start, span as a whole.
FULL_MARK, ABBREVIATION, INITIAL, ORDINAL, DATE, UNSURE, NAMED = 2.0, -6.0, -3.0, -4.0, -3.0, 0.0, -2.2
CAPITAL, KNOWN_OPENER, UNCASED, LOWER, QUOTED_LOWER, DIGIT, DASH, SPOKEN = 2.0, 0.5, 1.0, -5.0, -4.0, 0.0, -6.0, -8.0
NO_SPACE = -1.5
UNBALANCED, NO_WORD, ONE_LETTER, LONG_FROM, LONG = -5.0, -6.0, -2.0, 400, -0.001
#: No split gains more than this by the length of its spans, and none by their balance, so
#: candidates that score no better than its negative are never chosen and are left out.
MOST_GAINED = -LONG * LONG_FROM

#: Letters of the longest word that is learnt, the least pointed places of one, the share of its
#: places that have a point, and the most words that are learnt.
LONGEST_LEARNT, LEAST_SEEN, HAS_POINT, MOST_LEARNT = 5, 20, 0.95, 100_000
#: Distinct words that a task counts before it hands them on.
MOST_KEPT = 1_000_000
#: Letters in a row of which no abbreviation or word of consonants ends a longer one.
UNLISTED = 1 + max(6, LONGEST_LEARNT, *map(len, NEVER_FINAL | MAY_END | BEFORE_NAMES | AFTER_NUMBER | CALENDAR))
#: Stands for a blank line, or the end of a text, between words.
PARAGRAPH_END = " \ue000 "
#: Stands for a capitalised word that often opens a sentence.
OPENS = "\ue001"
BLANK_LINE = regex.compile(r"\n[^\S\n]*\n")

LINE = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
ITEM = regex.compile(r"[^\S\r\n]*(?:[-*•‣◦▪●·–+]|\(?\d{1,3}[.)]|\(?[A-Za-z]\))[^\S\r\n]+(?=\S)")
NUMBERED = regex.compile(r"\s*\(?(\d{1,3})[.)]")
HEADING = regex.compile(r"[^\S\r\n]*#{1,6}[^\S\r\n]")
CLOSED_ITEM = regex.compile(r"[.!?。！？।؟…][\"'”’»」』）)\]]*\s*\Z")

OPEN_CLOSE = {"«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "“": "”", "‹": "›", "《": "》"}
CLOSERS = set("»”」』)）]】›》")
BRACKET = regex.compile(r"[«»„“”「」『』()（）\[\]【】‹›《》\"]")
MARKS = regex.compile(r"[.!?…。．｡！？।॥؟۔;]+")
#: Two sentences between which the space is missing.
JOINED = regex.compile(r"\p{Ll}{2}[.!?][\"”»)]?\p{Lu}\p{Ll}")
QUOTE_END = frozenset("\"”“»」』›》'’")
CJK_MARK = frozenset("。．｡！？")
THAI = regex.compile(r"\p{Thai}")
THAI_GAP = regex.compile(r"(?<=\p{Thai})\p{Zs}+(?=[\p{Thai}\"“(«])|(?<=\p{Thai})\p{Zs}+(?=\p{Lu}[\p{Latin}.'’-]* +[\p{Latin}\d]+[.,]? +[\p{Latin}\d])")
#: The word that ends where the search ends; it is searched backwards.
LAST_WORD = regex.compile(r"(?r)(?:[\p{L}\p{M}\p{N}\p{Cf}]+[.'’])*[\p{L}\p{M}\p{N}\p{Cf}]+\Z")
UNSEEN = regex.compile(r"\p{Cf}+")
#: A short word of consonants only that isn't all capitals.
NO_VOWEL = regex.compile(r"(?=.+\p{Ll})(?:\p{Lu}?[b-df-hj-np-tv-xz]{2,5}|\p{Lu}?[бвгджзйклмнпрстфхцчшщ]{2,5})")
AND_SO_ON = regex.compile(r"(?i)\bт\.\s*[дп]\Z")
NUMBER_BEFORE = regex.compile(r"(?r)\d\s*[\p{L}\p{M}]+\Z")
WORD_BEFORE = regex.compile(r"(?r)([\p{L}\p{M}]+)\s+\d+\Z")
FIRST = regex.compile(r"[\"'“”„«‹「『《(（\[【¿¡*_`\s\p{Cf}]*")
#: What may stand between a closing mark and the end of its sentence.
CLOSING = regex.compile(r"[.!?…。．｡！？।॥؟۔;\"'”’“»›」』)）\]】*_`\p{Cf}]*\s*\Z|[.!?…。．｡！？।॥؟۔;\"'”’“»›」』)）\]】*_`\p{Cf}]*")
FIRST_WORD = regex.compile(r"[\p{L}\p{M}'’]+")
LETTER = regex.compile(r"[\p{L}\p{N}]")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
GREEK = regex.compile(r"\p{Greek}")
LATIN = regex.compile(r"\p{Latin}")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """``(begin, end, whole)`` of the blocks; a whole one, as a list item, isn't divided."""
    begin, whole, number = -1, False, 0
    at, end = 0, 0
    for match in [*LINE.finditer(text), None]:
        stop = match.start() if match else len(text)
        line = text[at:stop]
        if not line.strip():
            if begin >= 0:
                yield begin, end, whole
            begin, whole = -1, False
            number = 0 if begin < 0 and not line else number
        else:
            starts, heading = _item(line, number, begin < 0 or whole), HEADING.match(line) is not None
            if starts or heading or (whole and CLOSED_ITEM.search(text, begin, end)):
                if begin >= 0:
                    yield begin, end, whole
                begin, whole = at, starts or heading
                if starts and (n := NUMBERED.match(line)):
                    number = int(n[1])
            elif begin < 0:
                begin = at
            if heading:
                yield begin, stop, True
                begin, whole = -1, False
        end = stop
        at = match.end() if match else stop
    if begin >= 0:
        yield begin, end, whole


def _item(line: str, number: int, fresh: bool) -> bool:
    """Whether a line begins a list item; a number within running text must go on counting."""
    if not ITEM.match(line):
        return False
    own = NUMBERED.match(line)
    return own is None or fresh or int(own[1]) in (1, number + 1)


def _turns(text: str, at: int) -> int:
    """1 if the straight quotation mark at ``at`` opens by the space around it, -1 if it closes, 0 if unclear."""
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    left = not before or before.isspace() or before in OPEN_CLOSE or before in "-–—"
    right = not after or after.isspace() or after in ".,;:!?…" or after in CLOSERS
    return (left and not right) - (right and not left)


def nesting(text: str) -> tuple[list[tuple[int, tuple[str, ...]]], list[tuple[int, int]]]:
    """``(position after a quotation mark or bracket, those open there)``, in order, and the closed pairs as half-open spans."""
    states: list[tuple[int, tuple[str, ...]]] = [(0, ())]
    pairs: list[tuple[int, int]] = []
    open_: tuple[str, ...] = ()
    begun: list[int] = []
    for match in BRACKET.finditer(text):
        mark = match[0]
        opener = len(open_)  # the place of the mark that this one closes, if any
        if mark == '"':
            turn = _turns(text, match.start())
            if '"' in open_:
                opener = open_.index('"')
                if turn > 0:  # the mark before was never closed
                    open_, begun = open_[:opener], begun[:opener]
            elif turn < 0:
                continue
        elif open_ and mark in OPEN_CLOSE.get(open_[-1], ""):
            opener -= 1
        elif mark in CLOSERS:
            opener = next((k for k in range(len(open_) - 1, -1, -1) if mark in OPEN_CLOSE.get(open_[k], "")), -1)
            if opener < 0:
                continue
        if opener < len(open_):
            pairs.append((begun[opener], match.end()))
            open_, begun = open_[:opener], begun[:opener]
        else:
            open_, begun = (*open_, mark), [*begun, match.start()]
        states.append((match.end(), open_))
    return states, pairs


class _States:
    """What is open at a position, for positions asked in ascending order."""

    def __init__(self, states: list[tuple[int, tuple[str, ...]]]):
        self.states, self.k = states, 0

    def at(self, position: int) -> tuple[str, ...]:
        while self.k + 1 < len(self.states) and self.states[self.k + 1][0] <= position:
            self.k += 1
        return self.states[self.k][1]


def _after_closers(text: str, at: int, open_: tuple[str, ...]) -> int:
    """The position after the closing marks that follow ``at``; a spaced French one too."""
    while at < len(text):
        mark = text[at]
        if open_ and (mark in OPEN_CLOSE.get(open_[-1], "") or mark == open_[-1] == '"'):
            open_ = open_[:-1]
        elif open_ and mark in " \u00a0\u202f\u2009\n" and text[at + 1 : at + 2] == "»" and open_[-1] == "«":
            pass
        elif mark in "'’*_`" and (at + 1 >= len(text) or not text[at + 1].isalnum()) and text[at - 1] not in " \n":
            pass
        elif mark in ")]）】" and not open_:
            pass
        elif UNSEEN.match(mark):
            pass
        else:
            break
        at += 1
    return at


@dataclass(frozen=True)
class Lexicon:
    """Words that a corpus shows to be abbreviations, and those that it shows to be ordinary words."""

    abbreviations: frozenset[str] = frozenset()
    ordinary: frozenset[str] = frozenset()


def closing_score(text: str, mark_at: int, mark: str, lexicon: Lexicon = Lexicon()) -> float:
    """How well the word before a mark, and the mark, close a sentence."""
    if mark[0] != "." or len(mark) > 1:
        return UNSURE if set(mark) <= set(".…") else FULL_MARK
    if mark_at >= UNLISTED and text[mark_at - UNLISTED : mark_at].isalpha():
        return FULL_MARK  # longer than any word that counts
    found = LAST_WORD.search(text, max(0, mark_at - 40), mark_at)
    if found is None:
        return FULL_MARK
    word = found[0] if found[0].isascii() else UNSEEN.sub("", found[0])
    low = word.lower()
    if low.replace(".", "").isdigit():
        before = WORD_BEFORE.search(text, max(0, mark_at - 40), mark_at)
        return ORDINAL if len(low) < 3 and before and before[1].lower() in BEFORE_ORDINAL else FULL_MARK
    if low in MAY_END:
        return UNSURE
    if low in BEFORE_NAMES:
        return NAMED
    if low in AFTER_NUMBER and NUMBER_BEFORE.search(text, max(0, mark_at - 40), mark_at):
        return UNSURE
    if low in CALENDAR and low not in lexicon.ordinary:
        return DATE
    if low in lexicon.abbreviations or low in NEVER_FINAL and low not in lexicon.ordinary:
        return ABBREVIATION
    if len(word.rpartition(".")[2]) == 1 and not CJK.match(word):
        if low in "дп" and AND_SO_ON.search(text[max(0, mark_at - 6) : mark_at]):
            return UNSURE
        return INITIAL
    if NO_VOWEL.fullmatch(word) and low not in lexicon.ordinary and not NUMBER_BEFORE.search(text, max(0, mark_at - 40), mark_at):
        return ABBREVIATION
    return FULL_MARK


def opening_score(text: str, at: int, quoted: str) -> float:
    """How well the words at ``at`` open a sentence; ``quoted`` is the mark that ended a quotation just before.

    A quotation that ends in a full point was no part of the speaker's sentence that
    follows, so a speaker with a capital letter counts only after other marks.
    """
    first = FIRST.match(text, at).end()
    if first >= len(text):
        return UNCASED
    letter = text[first]
    if letter in "—–-,;:" and (letter != "-" or text[first + 1 : first + 2] == " "):
        return DASH
    if quoted and (quoted != "." and SPEAKER.match(text, at) or SPEAKER_HINDI.match(text, at) or SPEAKER_OTHER.match(text, at)):
        return SPOKEN
    if letter.islower():
        return LOWER if first == at else QUOTED_LOWER
    if letter.isdigit():
        return DIGIT
    if letter.isupper():
        word = FIRST_WORD.match(text, first)
        return CAPITAL + (KNOWN_OPENER if word and word[0].lower() in OPENERS else 0)
    return UNCASED


def _number_word(text: str, mark_at: int, start: int) -> bool:
    """``No.`` stands for a number before digits, and is a word of its own elsewhere."""
    if not text[start : start + 1].isdigit():
        return False
    word = LAST_WORD.search(text, max(0, mark_at - 8), mark_at)
    return word is not None and word[0].lower() in ("no", "p", "pt", "art", "ch", "n")


Candidate = tuple[int, int, float, tuple[str, ...]]


def candidates(text: str, lexicon: Lexicon = Lexicon()) -> list[Candidate]:
    """``(end, next start, score, open quotations)`` of every place where a sentence may end."""
    found, size = [], len(text)
    states_of, pairs = nesting(text)
    states = _States(states_of)
    for match in MARKS.finditer(text):
        mark = match[0]
        begin, end = match.span()
        joined = end < size and not text[end].isspace() and JOINED.match(text, max(0, begin - 2)) is not None
        if mark == "." and not joined and text[end : end + 1].isalnum():
            continue  # within a number, name or address
        if ";" in mark:
            near = text[max(0, begin - 60) : begin]
            if len(GREEK.findall(near)) <= len(LATIN.findall(near)) and not GREEK.match(text, max(0, begin - 1)):
                continue
        after = end
        end = _after_closers(text, after, states.at(begin) if pairs or states_of[1:] else ())
        start = end
        while start < size and text[start].isspace():
            start += 1
        if start >= size:
            continue
        tight = start == end
        joined = joined and tight
        if tight and not joined and not (CJK_MARK & set(mark)) and mark[-1] not in "।॥؟۔":
            continue
        if tight and text[start] in "，、；：,;:)）]】。.!?！？…":
            continue
        if _number_word(text, begin, start):
            continue
        quoted = mark[-1] if end > after and QUOTE_END & set(text[after:end]) else ""
        score = closing_score(text, begin, mark, lexicon) + opening_score(text, start, quoted) + (NO_SPACE if joined else 0)
        found.append((end, start, score))
    if THAI.search(text):
        found += [(m.start(), m.end(), FULL_MARK + UNCASED) for m in THAI_GAP.finditer(text)]
        found = sorted({f[0]: f for f in found}.values())
    if not states_of[1:]:
        return [(*place, ()) for place in found]
    ordered = _States(states_of)
    return outside_of_larger_sentences(text, [(end, start, score, ordered.at(end)) for end, start, score in found], pairs)


def outside_of_larger_sentences(text: str, places: list[Candidate], pairs: list[tuple[int, int]]) -> list[Candidate]:
    """The candidates that don't stand in a quotation or bracket which is part of a larger sentence.

    It is part of one if no sentence can begin at its opening mark or none can end at its
    closing mark. Its inner candidates gain nothing then, whatever their number and scores.
    """
    if not pairs or not places:
        return places
    likely = [p for p in places if p[2] > 0]
    begins = [0] + [p[1] for p in likely]
    ends = [p[0] for p in likely] + [len(text)]
    within: list[tuple[int, int]] = []
    for begin, end in pairs:
        k = bisect_right(begins, begin) - 1
        opens = FIRST.match(text, begins[k]).end() > begin
        k = bisect_left(ends, end)
        closes = CLOSING.match(text, end).end() >= ends[k]
        if not (opens and closes):
            within.append((begin, end))
    if not within:
        return places
    within.sort()
    furthest = list(accumulate((end for _, end in within), max))
    opened = [begin for begin, _ in within]

    def inside(at: int) -> bool:
        k = bisect_left(opened, at) - 1
        return k >= 0 and furthest[k] > at

    return [p for p in places if not inside(p[0])]


def span_score(text: str, begin: int, end: int, balanced: bool) -> float:
    """Length and balance of a span as a whole."""
    size = end - begin
    score = 0.0 if balanced else UNBALANCED
    if size > LONG_FROM:
        score += LONG * (size - LONG_FROM)
    elif size < 8:
        letters = len(LETTER.findall(text, begin, end))
        if letters == 0:
            score += NO_WORD
        elif letters == 1 and not CJK.search(text, begin, end):
            score += ONE_LETTER
    return score


def divide(text: str, lexicon: Lexicon = Lexicon()) -> list[tuple[int, int]]:
    """The best sequence of sentence spans of one block, which has no space at either end."""
    places = [p for p in candidates(text, lexicon) if p[2] > -MOST_GAINED]
    if not places:
        return [(0, len(text))]
    ends = [p[0] for p in places] + [len(text)]
    starts = [0] + [p[1] for p in places]
    weight = [p[2] for p in places] + [0.0]
    state = [()] + [p[3] for p in places] + [()]
    return _plain(text, starts, ends, weight, state) or best_spans(text, starts, ends, weight, state)


def _plain(text: str, starts: list[int], ends: list[int], weight: list[float], state: list[tuple[str, ...]]) -> list[tuple[int, int]] | None:
    """The best spans where all places of a positive score part spans that cost nothing: no choice is better then."""
    if any(state):
        return None
    chosen = [k for k in range(len(weight) - 1) if weight[k] > 0]
    spans = list(zip([0, *(starts[k + 1] for k in chosen)], [*(ends[k] for k in chosen), ends[-1]]))
    return None if any(span_score(text, b, e, True) for b, e in spans) else spans


def best_spans(text: str, starts: list[int], ends: list[int], weight: list[float], state: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """The semi-Markov dynamic program over whole spans between the places."""
    best = [0.0] + [float("-inf")] * len(ends)
    back = [0] * (len(ends) + 1)
    high = [0.0]  # the best score of any place so far; spans that can't beat what is found, and all longer ones, are passed over
    for j in range(1, len(ends) + 1):
        for i in range(j - 1, -1, -1):
            if high[i] + weight[j - 1] + LONG * max(0, ends[j - 1] - starts[i] - LONG_FROM) < best[j] - 1e-9:
                break
            score = best[i] + weight[j - 1] + span_score(text, starts[i], ends[j - 1], state[i] == state[j])
            if score >= best[j]:
                best[j], back[j] = score, i
        high.append(max(high[-1], best[j]))
    spans, j = [], len(ends)
    while j:
        spans.append((starts[back[j]], ends[j - 1]))
        j = back[j]
    return spans[::-1]


def sentence_spans(text: str | None, lexicon: Lexicon = Lexicon()) -> list[tuple[int, int]]:
    """Half-open spans, in code points, of the sentences of a text; none of a blank one."""
    spans: list[tuple[int, int]] = []
    for begin, end, whole in blocks(text or ""):
        while begin < end and text[begin].isspace():
            begin += 1
        while end > begin and text[end - 1].isspace():
            end -= 1
        if begin == end:
            continue
        found = [(0, end - begin)] if whole else divide(text[begin:end], lexicon)
        spans += [(begin + b, begin + e) for b, e in found if e > b]
    return spans


class _WordCounts:
    """Short words of a partition: how often without a point, and what followed their points."""

    def __init__(self) -> None:
        self.tokens: Counter[str] = Counter()
        self.pointed: Counter[tuple[str, str]] = Counter()

    def add(self, text: str) -> None:
        words = (BLANK_LINE.sub(PARAGRAPH_END, text) if "\n" in text else text).split()
        self.tokens.update([w for w in words if len(w) <= LONGEST_LEARNT + 3])
        self.pointed.update([(w, OPENS if after.lower() in OPENERS and after[0].isupper() else after[0]) for w, after in zip(words, [*words[1:], PARAGRAPH_END.strip()]) if w[-1] == "." and len(w) <= LONGEST_LEARNT + 3])

    def rows(self) -> dict[str, list[int]]:
        """``[plain, goes on, number, capital, end, opener]`` by word."""
        found: dict[str, list[int]] = {}
        for token, n in self.tokens.items():
            word = token.strip("\"'“”„«»‘’()[]*_,;:!?…")
            if word.isalpha() and 1 < len(word) <= LONGEST_LEARNT:
                found.setdefault(word.lower(), [0] * 6)[0] += n
        for (token, after), n in self.pointed.items():
            word = token[:-1].lstrip("\"'“”„«»‘’([*_")
            if word.isalpha() and 1 < len(word) <= LONGEST_LEARNT:
                kind = 5 if after == OPENS else 4 if after in PARAGRAPH_END else 1 if after.islower() or after in ",;:)" else 2 if after.isdigit() else 3
                found.setdefault(word.lower(), [0] * 6)[kind] += n
        return found


def learnt_words(df: DataFrame, text: str = "text") -> Lexicon:
    """The short words that the whole of ``df`` shows to be abbreviations, or ordinary words.

    An abbreviation has its point in ``HAS_POINT`` of its places, stands at the end of a
    paragraph in hardly any and goes on with a small letter or a number in some, or has been
    seen often and hardly ever before a word that opens sentences. A listed abbreviation is ordinary here if it mostly has no point, and ends
    paragraphs as other words do. Words with a point in less than one of ``MOST_LEARNT``
    pointed places teach nothing, so that at most so many are ever broadcast. Null and empty
    texts count for nothing, and an empty table teaches nothing.
    """
    names = ["plain", "inside", "number", "capital", "end_n", "opener"]

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(counts: _WordCounts) -> pa.RecordBatch:
            rows = counts.rows()
            columns = [pa.array(list(rows), pa.string()), *(pa.array([r[k] for r in rows.values()], pa.int64()) for k in range(6))]
            return pa.RecordBatch.from_arrays(columns, ["word", *names])

        counts = _WordCounts()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    counts.add(value)
            if len(counts.tokens) > MOST_KEPT:
                yield out(counts)
                counts = _WordCounts()
        yield out(counts)

    partial = df.select(text).mapInArrow(count, "word string, " + ", ".join(f"{n} long" for n in names))
    words = partial.groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).withColumn("pointed", sum((F.col(n) for n in names[2:]), F.col("inside")))
    kept = checkpoint(words.where("pointed > 0"))
    total = kept.agg(F.coalesce(F.sum("pointed"), F.lit(0)).alias("total")).first().total
    seen = kept.where(F.col("pointed") >= max(LEAST_SEEN, total / MOST_LEARNT))
    p = F.col("pointed")
    goes_on = F.col("inside") + F.col("number") >= 0.2 * p
    named = (p >= 5 * LEAST_SEEN) & (F.col("opener") * 20 <= p)
    short = (p >= HAS_POINT * (p + F.col("plain"))) & (F.col("end_n") * 50 <= p) & (goes_on | named)
    plain = (F.col("plain") >= p) & (F.col("end_n") * 20 >= p) & (F.col("inside") * 20 <= p)
    listed = F.col("word").isin(sorted(w for w in NEVER_FINAL | CALENDAR if len(w) <= LONGEST_LEARNT))
    found = seen.select("word", short.alias("short"), (plain & listed).alias("plain")).where("short or plain").collect()
    return Lexicon(frozenset(r.word for r in found if r.short), frozenset(r.word for r in found if r.plain))


def sentences(df: DataFrame, row_id: str = "doc_id", text: str = "text", with_text: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """``(row_id, begin_at, end_at)`` of every sentence, with its ``sentence`` on demand.

    Null, empty and blank texts have no rows. Offsets are half open, in code points from 0.
    Each row of ``df`` is divided on its own, whatever its length, so repeated rows give
    their sentences each; other columns are neither read nor returned. ``lexicon`` has the
    words learnt from a corpus, and is learnt from ``df`` if it isn't given.
    """
    shared = df.sparkSession.sparkContext.broadcast(learnt_words(df, text) if lexicon is None else lexicon)
    fields = [df.schema[row_id], T.StructField("begin_at", T.IntegerType()), T.StructField("end_at", T.IntegerType())]
    if with_text:
        fields.append(T.StructField("sentence", T.StringType()))
    schema = T.StructType(fields)

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = part.column(1).to_pylist()
                found = [sentence_spans(t, own) for t in texts]
                rows = pa.array([k for k, spans in enumerate(found) for _ in spans], pa.int32())
                columns = [part.column(0).take(rows)]
                columns += [pa.array([s[k] for spans in found for s in spans], pa.int32()) for k in (0, 1)]
                if with_text:
                    columns.append(pa.array([t[b:e] for t, spans in zip(texts, found) for b, e in spans], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(row_id, text).mapInArrow(split, schema)
