"""Token ids of a byte-level BPE vocabulary for every document.

A text is cut into pre-tokens by the vocabulary's pattern. The distinct pre-tokens of a batch
are looked up together in a minimal perfect hash of the whole vocabulary: one that is a
token itself gives its id at once. The others are merged from their bytes, which stand in a
linked list, with a heap of the adjacent pairs by rank and position.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Largest vocabulary file that is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens outside the vocabulary whose ids a worker remembers.
REMEMBERED = 200_000
MASK = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: a place below their number for each.

    Keys are hashed into buckets; buckets with several keys, the fullest first, try seeds
    until all their keys fall on free places, and those with one key take a place left over.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // 3)
        self.seed = np.zeros(self.buckets, np.int64)
        hashes = self.hashes(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(ends)
        free = bytearray(b"\x01") * self.size
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            mine = hashes[order[ends[b] : ends[b + 1]]].tolist()
            seed = 1
            while True:
                places = {self.mix_one(h, seed) for h in mine}
                if len(places) == len(mine) and all(free[p] for p in places):
                    break
                seed += 1
            for p in places:
                free[p] = 0
            self.seed[b] = seed
        taken = np.frombuffer(free, np.uint8) == 0
        alone = np.flatnonzero(sizes == 1)
        self.seed[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))

    def mix(self, hashes: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
        x = hashes ^ (np.asarray(seed, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.size)).astype(np.int64)

    def mix_one(self, h: int, seed: int) -> int:
        """The same as ``mix``, of one hash."""
        x = h ^ (seed * 0x9E3779B97F4A7C15 & MASK)
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & MASK
        return (x ^ (x >> 32)) % self.size

    def places(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key; of a key that isn't in the set, any place."""
        hashes = self.hashes(keys)
        seed = self.seed[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(seed < 0, -1 - seed, self.mix(hashes, np.maximum(seed, 0)))


class Vocabulary:
    """A byte-level BPE vocabulary whose ids are also the ranks of its merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        places = self.hash.places(keys)
        self.keys = [b""] * len(keys)
        self.ids = np.zeros(len(keys), np.int64)
        for key, place in zip(keys, places.tolist()):
            self.keys[place] = key
            self.ids[place] = ranks[key]
        self.remembered: dict[bytes, list[int]] = {}

    @classmethod
    def parse(cls, content: bytes, pattern: str) -> Vocabulary:
        """From lines of a base64 token and its rank."""
        pairs = (line.split() for line in content.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def merged(self, word: bytes) -> list[int]:
        """The ids of a pre-token that is no token itself."""
        ranks, size = self.ranks, len(word)
        end = list(range(1, size + 1))  # of the piece that begins at each byte, 0 once merged away
        before = list(range(-1, size - 1))
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, stop = heapq.heappop(heap)
            middle = end[at]
            if not middle or middle >= size or end[middle] != stop or stop <= middle:
                continue
            end[at], end[middle] = stop, 0
            if stop < size:
                before[stop] = at
                if (r := ranks.get(word[at : end[stop]])) is not None:
                    heapq.heappush(heap, (r, at, end[stop]))
            left = before[at]
            if left >= 0 and (r := ranks.get(word[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        ids, at = [], 0
        while at < size:
            ids.append(ranks[word[at : end[at]]])
            at = end[at]
        return ids

    def lookup(self, words: list[bytes]) -> list[list[int]]:
        """The ids of distinct pre-tokens: whole ones by the hash, the rest by merging."""
        found = []
        for word, place in zip(words, self.hash.places(words).tolist() if words else []):
            if self.keys[place] == word:
                found.append([int(self.ids[place])])
                continue
            ids = self.remembered.get(word)
            if ids is None:
                ids = self.merged(word)
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[word] = ids
            found.append(ids)
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(text) if text else [] for text in texts]
        words = list(dict.fromkeys(w for one in cut for w in one))
        ids = dict(zip(words, self.lookup([w.encode("utf-8", "surrogatepass") for w in words])))
        return [[i for w in one for i in ids[w]] for one in cut]


def encode_corpus(documents: DataFrame, vocabulary_path: str, pattern: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row_id, ids)`` of every row, in the vocabulary read from ``vocabulary_path`` by the driver.

    Null and empty texts have the empty list. Strings of special tokens are ordinary text.
    Every row gives one row, repeated ones included; other columns are neither read nor
    returned. The hash is built once, on the driver, and broadcast with the vocabulary,
    whose file must be below ``MAX_VOCABULARY_BYTES``.
    """
    with open(vocabulary_path, "rb") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary_path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary.parse(content, pattern))
    schema = T.StructType([documents.schema[row_id], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vocabulary = shared.value
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                ids = vocabulary.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], schema.names)

    return documents.select(row_id, text).mapInArrow(encode, schema)
