"""Passages of held-out evaluation texts inside a corpus, by the q-gram lemma.

Texts are reduced to their letters and digits: one consistent form of the characters, no
markup, case folded. A passage of length n with at most e edits shares at least
n + 1 - q (e + 1) of its q-grams with its source, on at most e + 1 neighbouring diagonals.
So the q-grams that a document shares with an item are counted in overlapping bands of
diagonals; bands that reach the item's bound are aligned within their band, and regions
that score as a passage with at most e edits are kept. The leak itself, a run of equal
words (of characters in scripts without spaces), is then checked exactly in these regions.
"""

from __future__ import annotations

import html
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagsieve.llm.confusables import LOOK_ALIKE, MIXABLE, LookAlikes, look_alikes

#: Edits that an aligned passage may hold, longest q-gram, and the cost of an edit in the alignment.
EDITS, LONGEST_Q, EDIT_COST = 2, 6, 3
#: Successive equal words, or characters of scripts without spaces, that make a leak.
LEAK_WORDS, LEAK_CHARACTERS = 10, 20
#: Languages written without spaces.
UNSPACED = ("zh", "ja", "th")
#: Item characters that are indexed and broadcast as a block, and blocks that one reading of the documents serves.
BLOCK_CHARACTERS = 2_000_000
BLOCKS_AT_ONCE = 4
#: Document characters that a task treats at once, and shared q-grams and bands within them.
BATCH_CHARACTERS = 1_000_000
HITS_AT_ONCE, BANDS_AT_ONCE, AT_ONCE = 2_000_000, 20_000, 1 << 15
#: Characters of all aligned parts that a task compares at once, or the one part that is longer.
CELLS_AT_ONCE = 1 << 21

WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Tags; a longer one must have attributes only, one of them with a value, so that text between two stray brackets stays.
TAGS = regex.compile(
    r"""</?[A-Za-z][^<>]{0,300}>|<[A-Za-z][\w:.-]*+(?=[^<>]*=(?:\s*["']|[^\s<>]))(?:\s++[A-Za-z_:@][\w:.-]*+(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]++))?+)*+\s*+/?>"""
)
ENTITY = regex.compile(r"&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,10});")


def _folded() -> dict[int, str]:
    """Lower-case letters that look like a Latin one in lower or upper case, to that letter."""
    fold: dict[str, str] = {}
    for row in sorted(LOOK_ALIKE, key=lambda r: r[0].isupper()):
        for other in row[1:]:
            if other != "." and row[0] != ".":
                fold.setdefault(other.casefold(), row[0].casefold())
    return {ord(k): v for k, v in fold.items() if len(k) == 1}


FOLDED = _folded()


def words_of(text: str | None, alike: LookAlikes) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    if "<" in text:
        text = TAGS.sub(" ", text)
    if "&" in text:
        text = ENTITY.sub(lambda m: html.unescape(m[0]), text)
    words = WORDS.findall(alike.consistent_form(text).casefold())
    if text.isascii() or not MIXABLE.search(text):
        return words
    folded = {w: w.translate(FOLDED) for w in set(words)}
    return [folded[w] for w in words]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram; none for fewer than q characters."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)  # of 21 bits each, so that three fit in one number
    if q < 3:
        packed = wide[:n] if q == 1 else (wide[:n] << np.uint64(21)) | wide[1 : n + 1]
        return mixed(packed * np.uint64(0x9E3779B97F4A7C15))
    triple = (wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]
    result = triple[:n] * np.uint64(0x9E3779B97F4A7C15)
    if q > 3:
        result = mixed(result) + triple[q - 3 : q - 3 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed(result)


def mixed(hashes: np.ndarray) -> np.ndarray:
    return hashes ^ (hashes >> np.uint64(29))


@dataclass(frozen=True)
class Item:
    item_id: int
    words: list[str]
    unspaced: bool

    @property
    def text(self) -> str:
        return "".join(self.words)

    def windows(self) -> set:
        """Every passage that makes a leak: tuples of words, or strings of characters."""
        if self.unspaced:
            return {self.text[k : k + LEAK_CHARACTERS] for k in range(len(self.text) - LEAK_CHARACTERS + 1)}
        return {tuple(self.words[k : k + LEAK_WORDS]) for k in range(len(self.words) - LEAK_WORDS + 1)}

    def shortest(self) -> int:
        """Characters of its shortest passage that makes a leak."""
        if self.unspaced:
            return LEAK_CHARACTERS
        sizes = np.array([len(w) for w in self.words])
        return int(np.convolve(sizes, np.ones(LEAK_WORDS, int), "valid").min())


class Index:
    """The q-grams of a block of items, with the bound and the exact passages of each."""

    def __init__(self, items: list[Item], edits: int = EDITS):
        self.items = [i for i in items if i.windows()]
        self.edits = edits
        self.stride = edits + 1
        self.windows = [i.windows() for i in self.items]
        shortest = np.array([i.shortest() for i in self.items] or [1])
        self.q = int(max(1, min(LONGEST_Q, shortest.min() // (edits + 1))))
        self.least = np.maximum(1, shortest + 1 - self.q * (edits + 1))
        self.score = np.maximum(1, shortest - edits * (1 + EDIT_COST))
        codes = [points(i.text) for i in self.items]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.begins = np.r_[0, np.cumsum(self.sizes)]
        self.codes = np.concatenate([*codes, np.ones(1, np.uint32)])
        self.longest = int(self.sizes.max(initial=0))
        grams = [gram_hashes(c, self.q) for c in codes]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first = np.unique(hashes[order], return_index=True)
        self.last = np.r_[self.first[1:], len(order)]
        self.owner, self.place = owner[order], place[order]
        self.held = np.zeros(1 << 20, bool)  # low bits of the hashes, which turn most q-grams away
        self.held[self.low(self.hashes)] = True

    def low(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.held) - 1)).astype(np.int64)

    def seen(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of the documents' q-grams that may be an item's, taken in parts that a processor's cache holds."""
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at in range(0, len(codes), AT_ONCE):
            grams = gram_hashes(codes[at : at + AT_ONCE + self.q - 1], self.q)
            own = np.flatnonzero(self.held[self.low(grams)])
            hashes.append(grams[own])
            places.append(own + at)
        return np.concatenate(hashes), np.concatenate(places)

    def hits(self, grams: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(item, place in the item, place in the documents)`` of every shared q-gram, in parts of bounded size."""
        if not len(self.hashes):
            return
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        same = self.hashes[at] == grams
        found, at = found[same], at[same]
        first, count = self.first[at], (self.last - self.first)[at]
        part = np.cumsum(count) // HITS_AT_ONCE
        for own in np.split(np.arange(len(found)), np.flatnonzero(np.diff(part)) + 1):
            n = count[own]
            posting = np.repeat(first[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            yield self.owner[posting], self.place[posting], np.repeat(found[own], n)

    def bands(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, document, first diagonal)`` of the bands that share enough q-grams.

        A band spans two strides of ``edits + 1`` diagonals, and bands overlap by one, so
        that every passage with its edits lies wholly in one of them. ``starts`` has the
        place at which each document begins, and one more.
        """
        ahead = self.longest // self.stride + 2  # bands of diagonals on which the item begins before the document
        room = np.r_[0, np.cumsum(np.diff(starts) // self.stride + ahead + 2)]
        wide = int(room[-1]) + 1
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for item, place, at in self.hits(*self.seen(codes)):
            document = np.searchsorted(starts, at, "right") - 1
            band = (at - starts[document] - place) // self.stride + ahead
            own, n = counted(item * wide + room[document] + band)
            keys, counts = (own, n) if not len(keys) else counted(np.concatenate([keys, own]), np.concatenate([counts, n]))
        if len(keys):  # each stride counts for the band that it begins and for the one that it ends
            after = np.r_[np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0), 0]
            first = np.r_[True, keys[1:] != keys[:-1] + 1]
            keys, counts = np.concatenate([keys, keys[first] - 1]), np.concatenate([counts + after, counts[first]])
        owner, at = keys // wide, keys % wide
        kept = counts >= self.least[owner] if len(keys) else np.zeros(0, bool)
        owner, at = owner[kept], at[kept]
        document = np.searchsorted(room, at, "right") - 1
        return owner, document, (at - room[document] - ahead) * self.stride

    def align(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """The best local alignment score of each band with its document, which has ``size`` characters from ``begin``.

        Only the part of an item that its band shares with the document is aligned, and
        bands of parts of about the same length advance together.
        """
        width = 2 * self.stride + 2 * self.edits
        first = np.maximum(0, self.edits - diagonal - width + 1)
        steps = np.maximum(0, np.minimum(self.sizes[item], size - diagonal + self.edits) - first)
        best = np.zeros(len(item), np.int32)
        classes = np.frexp(steps)[1]
        for length in np.unique(classes).tolist():
            own = np.flatnonzero(classes == length)
            for part in np.array_split(own, -(-len(own) << max(length, 4)) // CELLS_AT_ONCE + 1):
                if len(part):
                    best[part] = self.align_alike(codes, begin[part], size[part], item[part], diagonal[part], first[part], int(steps[part].max()), width)
        return best

    def align_alike(self, codes, begin, size, item, diagonal, first, steps: int, width: int) -> np.ndarray:
        """``align`` for bands whose parts are at most ``steps`` long, all advancing together."""
        place = first[:, None] + np.arange(steps)
        wanted = np.where(place < self.sizes[item][:, None], self.codes[np.minimum(self.begins[item][:, None] + place, len(self.codes) - 1)], 1)
        at = (diagonal - self.edits + first)[:, None] + np.arange(steps + width - 1)
        region = np.where((at >= 0) & (at < size[:, None]), codes[np.clip(begin[:, None] + at, 0, len(codes) - 1)], 0)
        # one row a diagonal and one a step, so that a step works on whole rows
        region, wanted = np.ascontiguousarray(region.T), np.ascontiguousarray(wanted.T)
        score = np.zeros((width, len(item)), np.int16 if steps < 1 << 13 else np.int32)
        best = np.zeros(len(item), score.dtype)
        for i in range(steps):
            new = score + np.where(region[i : i + width] == wanted[i], score.dtype.type(1), score.dtype.type(-EDIT_COST))
            np.maximum(new[:-1], score[1:] - score.dtype.type(EDIT_COST), out=new[:-1])
            for _ in range(self.edits):
                np.maximum(new[1:], new[:-1] - score.dtype.type(EDIT_COST), out=new[1:])
            score = np.maximum(new, 0, out=new)
            np.maximum(best, score.max(axis=0), out=best)
        return best.astype(np.int32)

    def leaks(self, documents: list[list[str]]) -> list[tuple[int, int, int, bool]]:
        """``(document, item, score, exact)`` of every document and item with a kept region."""
        texts = ["".join(words) for words in documents]
        return self.found(documents, texts, *joined(texts))

    def found(self, documents: list[list[str]], texts: list[str], codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """``leaks`` of documents that are put together already."""
        if not self.items:
            return []
        item, document, diagonal = self.bands(codes, starts)
        if not len(item):
            return []
        sizes = np.array([len(t) for t in texts], np.int64)
        parts = [slice(k, k + BANDS_AT_ONCE) for k in range(0, len(item), BANDS_AT_ONCE)]
        scores = np.concatenate([self.align(codes, starts[document[p]], sizes[document[p]], item[p], diagonal[p]) for p in parts])
        kept = scores >= self.score[item]
        result: dict[tuple[int, int], tuple[int, bool]] = {}
        word_starts: dict[int, np.ndarray] = {}
        for k, doc, d, s in zip(item[kept].tolist(), document[kept].tolist(), diagonal[kept].tolist(), scores[kept].tolist()):
            begin, end = d - self.edits, d + int(self.sizes[k]) + 2 * self.stride + self.edits
            old = result.get((doc, k), (0, False))
            exact = old[1] or self.exact(documents[doc], texts[doc], word_starts, doc, k, begin, end)
            result[doc, k] = max(old[0], s), exact
        return [(doc, self.items[k].item_id, s, exact) for (doc, k), (s, exact) in result.items()]

    def exact(self, words: list[str], text: str, word_starts: dict, doc: int, k: int, begin: int, end: int) -> bool:
        """Whether the region of a document holds a whole passage that makes a leak."""
        wanted = self.windows[k]
        if self.items[k].unspaced:
            region = text[max(0, begin) : end]
            return any(region[x : x + LEAK_CHARACTERS] in wanted for x in range(len(region) - LEAK_CHARACTERS + 1))
        if doc not in word_starts:
            word_starts[doc] = np.cumsum([0] + [len(w) for w in words])
        low, high = np.searchsorted(word_starts[doc], [max(0, begin), end])
        region = words[max(0, low - 1) : high + 1]
        return any(tuple(region[x : x + LEAK_WORDS]) in wanted for x in range(len(region) - LEAK_WORDS + 1))


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each occurs, or the sum of its weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    sums = np.diff(np.r_[first, len(keys)]) if weights is None else np.add.reduceat(weights, first) if len(first) else weights
    return keys[first], sums


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts with a gap after each that no q-gram of an item holds, and where each text begins."""
    starts = np.r_[0, np.cumsum([len(t) + LONGEST_Q for t in texts])].astype(np.int64)
    return points("\0" .join(t + "\0" * (LONGEST_Q - 1) for t in texts) + "\0" * bool(texts)), starts


#: The indexes of blocks that this worker has built, by the token of their search and number.
_BUILT: dict[tuple[str, int], Index] = {}


def built_index(token: str, number: int, items: list[Item], edits: int) -> Index:
    """The index of a block, built once a worker and kept until those of other blocks need its place."""
    if (token, number) not in _BUILT:
        while len(_BUILT) >= BLOCKS_AT_ONCE:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[token, number] = Index(items, edits)
    return _BUILT[token, number]


def item_blocks(items: DataFrame, block_characters: int, alike: LookAlikes) -> Iterator[list[Item]]:
    """The items in blocks of at most so many characters (one longer item is a block of its own)."""
    block, size = [], 0
    for item_id, lang, text in items.select("item_id", "lang", "text").where("text is not null").toLocalIterator():
        item = Item(item_id, words_of(text, alike), (lang or "").lower()[:2] in UNSPACED)
        if block and size + len(item.text) > block_characters:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item.text)
    if block:
        yield block


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    edits: int = EDITS,
    block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """``(row_id, item_id, score, exact)`` of every document with a passage of an item.

    ``score`` is the characters of the best aligned passage less the cost of its edits;
    ``exact`` says that it holds a run of ``LEAK_WORDS`` equal words, or, for items in
    scripts without spaces, of ``LEAK_CHARACTERS`` equal characters. Items shorter than
    that can't leak. Documents and items with null or empty texts have no pairs; repeated
    documents have pairs each, and an empty table on either side gives none. ``items`` is
    a query set, read in blocks that are each broadcast; documents are never shuffled, and
    are read once for every ``BLOCKS_AT_ONCE`` blocks.
    """
    context = documents.sparkSession.sparkContext
    alike = look_alikes(documents.sparkSession)
    letters = context.broadcast(alike)
    schema = T.StructType(
        [
            documents.schema[row_id],
            T.StructField("item_id", T.LongType()),
            T.StructField("score", T.IntegerType()),
            T.StructField("exact", T.BooleanType()),
        ]
    )

    def search(token: str, shared: list):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            def found(ids: pa.Array, first: int, documents: list) -> pa.RecordBatch:
                texts = ["".join(words) for words in documents]
                codes, starts = joined(texts)
                leaks = [x for k, block in enumerate(shared) for x in built_index(token, k, block.value, edits).found(documents, texts, codes, starts)]
                columns = [ids.take(pa.array([first + x[0] for x in leaks], pa.int32())), pa.array([x[1] for x in leaks], pa.int64())]
                columns += [pa.array([x[2] for x in leaks], pa.int32()), pa.array([x[3] for x in leaks], pa.bool_())]
                return pa.RecordBatch.from_arrays(columns, schema.names)

            for batch in batches:
                documents, first, size = [], 0, 0
                for value in batch.column(1).to_pylist():
                    documents.append(words_of(value, letters.value))
                    size += len(value or "")
                    if size > BATCH_CHARACTERS:
                        yield found(batch.column(0), first, documents)
                        documents, first, size = [], first + len(documents), 0
                yield found(batch.column(0), first, documents)

        return run

    result, shared = None, []

    def searched() -> DataFrame:
        part = documents.select(row_id, text).mapInArrow(search(uuid.uuid4().hex, list(shared)), schema)
        return part if result is None else result.unionByName(part)

    for block in item_blocks(items, block_characters, alike):
        shared.append(context.broadcast(block))
        if len(shared) == BLOCKS_AT_ONCE:
            result, shared = searched(), []
    if shared:
        result = searched()
    return documents.sparkSession.createDataFrame([], schema) if result is None else result
