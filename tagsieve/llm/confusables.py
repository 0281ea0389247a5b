"""One consistent form for text that looks the same but differs in its characters.

Invisible characters are removed, compatibility forms (full-width letters, ligatures, odd
spaces) replaced by ordinary ones and letters stored in parts composed. Then every token
gets its resolved script set, the intersection of the scripts its letters may belong to. A
token whose intersection is empty mixes scripts; if its letters have look-alikes in one of
its scripts it is spelled in that script. A token of one script that could be read wholly in
another is a whole-script confusable: it is reported and its form stays, as it may well be a
word of its own script; the key, which is for comparing, spells it in the first script of its
readings, so that all its disguises have one key.

Which letters look alike comes from the public confusables data of Unicode, as the JVM's ICU
library holds them, for all scripts; letters may belong to several scripts by their script
extensions.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Letters that look alike, as Latin, Cyrillic, Greek; a dot where a script has none.
LOOK_ALIKE = """
AАΑ BВΒ CС. EЕΕ GԌ. HНΗ IІΙ JЈͿ KКΚ MМΜ N.Ν OОΟ PРΡ QԚ. SЅ. TТΤ VѴ. WԜ. XХΧ YУΥ Z.Ζ
aаα cс. dԁ. eе. hһ. iіι jјϳ kкκ oоο pрρ qԛ. sѕ. u.υ v.ν wԝ. xхχ yуγ
""".split()
#: Further pairs of a Latin letter and one that looks like it.
ALSO_LIKE = "vѵ YҮ yү"

#: Scripts in the order of preference where nothing else decides; others follow by name.
SCRIPTS = ("Latin", "Cyrillic", "Greek")
#: Scripts that one token may mix, as in the usual profiles for identifiers.
AUGMENTED = {"Han": ("Jpan", "Kore", "Hanb"), "Hiragana": ("Jpan",), "Katakana": ("Jpan",), "Hangul": ("Kore",), "Bopomofo": ("Hanb",)}
ALL = frozenset({"*"})

INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]")
ODD_SPACE = regex.compile(r"[\p{Zs}--\ ]", regex.V1)
WORD = regex.compile(r"[\p{L}\p{M}]+")
MIXABLE = regex.compile(r"[\p{Script=Cyrillic}\p{Script=Greek}]")
#: Stands between letters whose prototypes are looked up together; it is its own prototype.
PART = "\ue000"


def _preferred(script: str) -> tuple[int, str]:
    return (SCRIPTS.index(script) if script in SCRIPTS else len(SCRIPTS), script)


@dataclass(repr=False)
class LookAlikes:
    """Letters that look alike, by script, and the scripts of all letters; small enough for any task."""

    like: dict[str, dict[str, str]]
    starts: list[int]
    scripts: list[frozenset[str]]
    mixable: str
    known: dict = field(default_factory=dict)
    own: dict = field(default_factory=dict)
    plain: set = field(default_factory=set)
    odd: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.pattern = re.compile(self.mixable)

    def __getstate__(self) -> tuple:
        return self.like, self.starts, self.scripts, self.mixable

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @classmethod
    def of(cls, classes: list[list[str]], scripts_of: dict[str, frozenset[str]], usual: Callable[[str], bool]) -> LookAlikes:
        """From classes of letters that look alike, earlier ones first, and the scripts of every letter.

        A letter's look-alike in a script is in ``usual`` use, has its case, or none, and the
        smallest code point of those. Letters that aren't their own compatibility form are left out, as the form
        replaces them before.
        """
        like: dict[str, dict[str, str]] = {}
        for members in classes:
            stable = [c for c in sorted(members) if c in scripts_of and unicodedata.normalize("NFKC", c) == c == unicodedata.normalize("NFD", c)]
            for letter in stable:
                case, mine = unicodedata.category(letter), scripts_of[letter]
                for other in sorted(filter(usual, stable), key=lambda c: unicodedata.category(c) != case):
                    if case == unicodedata.category(other) or {case, unicodedata.category(other)} & {"Lo", "Lm"}:
                        for script in scripts_of[other] - mine:
                            like.setdefault(letter, {}).setdefault(script, other)
        ordered = sorted(scripts_of.items())
        starts, sets = [0], [frozenset()]
        for k, (letter, scripts) in enumerate(ordered):
            if scripts != sets[-1] or ord(letter) != ord(ordered[k - 1][0]) + 1:
                if k and ord(letter) != ord(ordered[k - 1][0]) + 1:
                    starts.append(ord(ordered[k - 1][0]) + 1)
                    sets.append(frozenset())
                starts.append(ord(letter))
                sets.append(scripts)
        if ordered:
            starts.append(ord(ordered[-1][0]) + 1)
            sets.append(frozenset())
        # a text needs a look at its tokens if it has letters of a script that others are confused with, Latin and East Asian ones aside
        confused = {s for own in like.values() for s in own}.union(*(scripts_of[c] for c in like)) - {"Latin", "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo"}
        ranges = [(begin, end - 1) for begin, end, own in zip(starts, starts[1:], sets) if own & confused and begin < 0x10000]
        return cls(like, starts, sets, "[" + "".join(f"\\u{b:04x}-\\u{min(e, 0xFFFF):04x}" for b, e in ranges) + "\U00010000-\U0010ffff]")

    def scripts_of(self, letter: str) -> frozenset[str]:
        """The scripts a character may belong to; common and inherited ones belong to all."""
        if letter not in self.own:
            found = ALL if unicodedata.category(letter)[0] == "M" else self.scripts[bisect_right(self.starts, ord(letter)) - 1] or ALL
            self.own[letter] = found if found is ALL else found.union(*(AUGMENTED.get(s, ()) for s in found))
        return self.own[letter]

    def resolved_scripts(self, token: str) -> frozenset[str]:
        """The intersection of the scripts of a token's letters: empty if it mixes scripts."""
        result = ALL
        for letter in token:
            own = self.scripts_of(letter)
            result = own if result is ALL else result if own is ALL else result & own
        return result

    def spelled_in(self, token: str, script: str) -> str | None:
        """The token written wholly in a script by look-alikes, None if a letter has none."""
        out = []
        for letter in unicodedata.normalize("NFD", token):
            own = self.scripts_of(letter)
            if own is ALL or script in own:
                out.append(letter)
            elif (other := self.like.get(letter, {}).get(script)) is not None:
                out.append(other)
            else:
                return None
        return unicodedata.normalize("NFC", "".join(out))

    def readings(self, token: str) -> tuple[str, str | None, dict[str, str]]:
        """``single``, ``mixed`` or ``whole`` (confusable as a whole), the token's script, and its spellings by script.

        The spellings of a mixed token stand in the order of preference: scripts with more
        letters of the token first, then Latin, Cyrillic, Greek, others. Tokens whose
        letters of different scripts don't look alike, as in a unit with a Greek sign,
        count as single, of no script.
        """
        if token not in self.known:
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[token] = self._readings(token)
        return self.known[token]

    def _readings(self, token: str) -> tuple[str, str | None, dict[str, str]]:
        letters = unicodedata.normalize("NFD", token)
        sets = [own for c in letters if (own := self.scripts_of(c)) is not ALL]
        resolved = self.resolved_scripts(token)
        if resolved:
            own = None if resolved is ALL else min(resolved, key=_preferred)
            reach = [set(self.like.get(c, ())) | self.scripts_of(c) for c in letters if self.scripts_of(c) is not ALL]
            others = set.intersection(*reach) - resolved if reach else set()
            found = {s: x for s in sorted(others, key=_preferred) if (x := self.spelled_in(token, s)) is not None}
            return ("whole", own, found) if found else ("single", own, {})
        counts = {s: sum(s in own for own in sets) for s in set().union(*sets)}
        found = {s: x for s in sorted(counts, key=lambda s: (-counts[s], _preferred(s))) if (x := self.spelled_in(token, s)) is not None}
        return ("mixed", None, found) if found else ("single", None, {})

    def odd_words(self, words: set[str]) -> set[str]:
        """Those of the words that mix scripts or could be read in another; what a word is is kept."""
        for word in words - self.plain - self.odd:
            (self.plain if self.readings(word)[0] == "single" else self.odd).add(word)
        found = words & self.odd
        if len(self.plain) + len(self.odd) > 1 << 18:
            self.plain.clear()
            self.odd.clear()
        return found

    def spelled_alike(self, form: str, words: list[str], odd: set[str], keyed: bool) -> tuple[str, str, int]:
        """The form with its mixed tokens in one script, the key for comparing it, and its whole-script confusables.

        ``words`` are the tokens of the form and ``odd`` its odd words. Without ``keyed`` the
        key is the form, and confusables aren't counted.
        """
        kinds = {w: self.readings(w) for w in odd}
        spelled: dict[str, str] = {}
        if mixed := {w: r[2] for w, r in kinds.items() if r[0] == "mixed"}:
            context = self.context_script(words) if any(len(options) > 1 for options in mixed.values()) else None
            spelled = {w: options.get(context) or next(iter(options.values())) for w, options in mixed.items()}
        whole, compared = 0, form
        if keyed:
            whole = sum(kinds[w][0] == "whole" for w in words if w in odd)
            keys = {w: x for w in odd if (x := self.key(unicodedata.normalize("NFC", spelled.get(w, w)))) != w}
            if keys:
                compared = unicodedata.normalize("NFC", WORD.sub(lambda match: keys.get(match[0], match[0]), form))
        if spelled:
            form = unicodedata.normalize("NFC", WORD.sub(lambda match: spelled.get(match[0], match[0]), form))
        return form, compared if keyed else form, whole

    def key(self, token: str) -> str:
        """The token's spelling in the first script of all its readings."""
        kind, own, options = self.readings(token)
        return token if kind != "whole" or own == min([own, *options], key=_preferred) else next(iter(options.values()))

    def context_script(self, words: list[str]) -> str | None:
        """The script of most letters, of those of the three usual ones if there are any."""
        counts: Counter[str] = Counter()
        for letter, n in Counter("".join(words)).items():
            if (own := self.scripts_of(letter)) is not ALL:
                counts.update({s: n for s in own})
        usual = {s: counts[s] for s in SCRIPTS if counts[s]}
        return max(usual or sorted(counts, key=_preferred), key=counts.__getitem__, default=None)

    def inspect(self, text: str, keyed: bool = True) -> tuple[str, dict[str, bool], int, str]:
        """The consistent form of a text, what made it differ, its whole-script confusables and the key for comparing it."""
        flags = dict.fromkeys(FLAGS, False)
        if text.isascii():
            return text, flags, 0, text
        form, whole = text, 0
        flags["invisible"] = INVISIBLE.search(text) is not None
        # of the odd spaces only one is its own compatibility form
        if flags["invisible"] or not unicodedata.is_normalized("NFKC", text) or "\u1680" in text:
            flags["space"] = ODD_SPACE.search(text) is not None
            plain_spaces = ODD_SPACE.sub(" ", text) if flags["space"] else text
            composed = unicodedata.normalize("NFC", plain_spaces)
            flags["parts"] = composed != plain_spaces
            flags["compatibility"] = unicodedata.normalize("NFKC", plain_spaces) != composed
            form = unicodedata.normalize("NFKC", INVISIBLE.sub("", plain_spaces))
        if self.pattern.search(text) or self.pattern.search(form):
            words = WORD.findall(form)
            odd = self.odd_words(set(words))
            before = odd if form is text else self.odd_words(set(WORD.findall(text)))
            flags["mixed"] = any(self.readings(w)[0] == "mixed" for w in before)
            if odd:
                form, key, whole = self.spelled_alike(form, words, odd, keyed)
                return form, flags, whole, key
        return form, flags, whole, form

    def consistent_form(self, text: str) -> str:
        return self.inspect(text, keyed=False)[0]


_PUBLIC: list[LookAlikes] = []


def look_alikes(spark: SparkSession) -> LookAlikes:
    """The public confusables of all letters with the further fixed ones, built once a driver."""
    if not _PUBLIC:
        icu = spark.sparkContext._jvm.com.ibm.icu
        letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c.isalpha()]
        prototypes = icu.text.SpoofChecker.Builder().build().getSkeleton(PART.join(letters)).split(PART)
        by_prototype: dict[str, list[str]] = {}
        for letter, prototype in zip(letters, prototypes, strict=True):
            by_prototype.setdefault(prototype, []).append(letter)
        rows = [[c for c in row if c != "."] for row in [*LOOK_ALIKE, *ALSO_LIKE.split()]]
        scripts: dict[str, set[str]] = {}
        every = "".join(letters)
        for k in range(icu.lang.UScript.CODE_LIMIT):
            name = icu.lang.UScript.getName(k)
            try:
                found = regex.findall(rf"\p{{Script_Extensions={name}}}", every)
            except regex.error:  # a script that holds no characters yet
                continue
            if name not in ("Common", "Inherited", "Unknown"):
                for letter in found:
                    scripts.setdefault(letter, set()).add(name)
        classes = [*rows, *(members for members in by_prototype.values() if len(members) > 1)]
        _PUBLIC.append(LookAlikes.of(classes, {c: frozenset(s) for c, s in scripts.items()}, lru_cache(None)(icu.text.SpoofChecker.RECOMMENDED.contains)))
    return _PUBLIC[0]


FLAGS = ("compatibility", "parts", "invisible", "space", "mixed")


def consistent_forms(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row_id, form, compatibility, parts, invisible, space, mixed, whole_script, key)`` of every row.

    ``form`` is the consistent form; the flags say what the original held; ``whole_script``
    counts its tokens that could be read wholly in another script. ``key`` is the form with
    these spelled in the first script of their readings: texts that look alike have one
    key. A null text has a null
    form and key, no flag and no such token; an empty text is its own form. Texts are processed
    whole, repeated rows stay, and other columns are neither read nor returned.
    """
    flags = [T.StructField(f, T.BooleanType()) for f in FLAGS]
    schema = T.StructType([df.schema[row_id], T.StructField("form", T.StringType()), *flags, T.StructField("whole_script", T.IntegerType()), T.StructField("key", T.StringType())])
    none = (None, dict.fromkeys(FLAGS, False), 0, None)
    shared = df.sparkSession.sparkContext.broadcast(look_alikes(df.sparkSession))

    def convert(batches: Iterator) -> Iterator:
        import pyarrow as pa

        inspect = shared.value.inspect
        for batch in batches:
            found = [none if t is None else inspect(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string())]
            columns += [pa.array([f[1][name] for f in found], pa.bool_()) for name in FLAGS]
            columns += [pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return df.select(row_id, text).mapInArrow(convert, schema)
