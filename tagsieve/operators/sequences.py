"""Ragged sequences, and variation n-grams over tokens and spans.

The long form is one row a token, ``(sent_id, pos, token, ...)``; the nested form one row a
sentence. Rows with a null token or label take part in no n-gram and come out unflagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.operators.skew import skew_join
from tagsieve.plans.runtime import checkpoint, stored

#: Joins the tokens of an n-gram to one key; tokens hold no such character.
SEPARATOR = "\u0001"
#: Share of all occurrences from which an n-gram is joined by broadcast.
HEAVY_SHARE = 0.005
#: Tokens of the longest n-gram that is looked at in any place.
SHORT = 6
#: Tokens that may follow an open place on average for all its lengths to be taken at once.
ROOM = 32


def _heavy(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Keys of at least the heavy share of all counted rows: at most 1 / share of them."""
    total = counts.agg(F.sum(n).alias("all"))
    return counts.crossJoin(F.broadcast(total)).where(F.col(n) >= HEAVY_SHARE * F.col("all")).select(key)


def unflatten(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """One row a sentence, with the values of each column in an array in order of position."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    nested = tokens.groupBy("sent_id").agg(ordered.alias("rows"))
    return nested.select("sent_id", *[F.col("rows")[c].alias(c) for c in columns])


def flatten(sentences: DataFrame, columns: list[str]) -> DataFrame:
    """One row a token, ``(sent_id, pos, ...)``; empty and null arrays give none."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    rows = sentences.select("sent_id", F.posexplode(zipped).alias("pos", "x"))
    return rows.select("sent_id", "pos", *[F.col(f"x.{c}").alias(c) for c in columns])


def sizes(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("sent_id").agg(F.count("*").alias("size"))


def first_sentences(tokens: DataFrame, n: int) -> DataFrame:
    """The tokens of the n sentences of the smallest ids; an error if there are fewer."""
    ids = tokens.select("sent_id").distinct().orderBy("sent_id").limit(n)
    if ids.count() < n:
        raise IndexError(f"there are fewer than {n} sentences")
    return tokens.join(F.broadcast(ids), "sent_id", "left_semi")


def occurrences(haystack: Column, needle: Column) -> Column:
    """All half-open places, overlapping ones too, at which ``needle`` stands in ``haystack``."""
    last = F.size(haystack) - F.size(needle)
    starts = F.when((last >= 0) & (F.size(needle) > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda k: F.slice(haystack, k + 1, F.size(needle)) == needle)
    return F.transform(hits, lambda k: F.struct(k.alias("begin_at"), (k + F.size(needle)).alias("end_at")))


def hashed_sentences(tokens: DataFrame, form: str, label: str) -> DataFrame:
    """``(sent_id, x)``: the tokens of each sentence in order, with 64-bit hashes of form and label where both are there.

    Tokens without a sentence or position are left out.
    """
    usable = F.col(form).isNotNull() & F.col(label).isNotNull()
    hashes = {"a": F.xxhash64(form), "b": F.xxhash64(form, F.lit(1)), "t": F.xxhash64(label)}
    row = F.struct("pos", F.when(usable, F.col(form)).alias("w"), F.when(usable, F.col(label)).alias("y"), *[F.when(usable, h).alias(k) for k, h in hashes.items()])
    placed = tokens.where("sent_id is not null and pos is not null").select("sent_id", row.alias("x"))
    return placed.groupBy("sent_id").agg(F.array_sort(F.collect_list("x")).alias("x"))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    h = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Flat:
    """The sentences of an Arrow batch as flat arrays."""

    def __init__(self, sent_ids, x):
        flat = x.flatten()
        self.hashes = [flat.field(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in "abt"]
        usable = flat.field("a").is_valid().to_numpy(zero_copy_only=False)
        sizes = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.r_[0, np.cumsum(sizes)]
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(flat))
        # each usable token's run goes on to the next unusable one or the end of the sentence
        bad = np.where(usable, len(flat), at)
        self.stop = np.minimum(np.minimum.accumulate(bad[::-1])[::-1], self.first[self.row + 1])
        edge = _mix(np.arange(1, len(sizes) + 1).astype(np.uint64) * 0 + np.uint64(3), sent_ids.cast("int64").to_numpy(zero_copy_only=False).view(np.uint64))
        self.edge = edge[self.row] if len(flat) else np.zeros(0, np.uint64)
        before = np.r_[np.uint64(0), self.hashes[0][:-1]] if len(flat) else self.edge
        inner = (at > self.first[self.row]) & np.r_[False, usable[:-1]][: len(flat)]
        self.left = np.where(inner, before, self.edge)
        self.usable = usable

    def right(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        after = np.minimum(at + n, len(self.usable) - 1)
        inner = (at + n < self.first[self.row[at] + 1]) & self.usable[after]
        return np.where(inner, self.hashes[0][after], self.edge[at])

    def rows(self, at: np.ndarray, n: np.ndarray, gram: list[np.ndarray]) -> list:
        """``[row, k, n, g, l, r, t]`` of n-grams: the key is their length and 128 bits of their forms' hashes."""
        import pyarrow as pa

        key = np.zeros(len(at), [("a", "<u8"), ("b", "<u8"), ("n", "<i4")])
        key["a"], key["b"], key["n"] = gram[0], gram[1], n
        offsets = np.arange(len(at) + 1, dtype=np.int32) * 20
        keys = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(key.tobytes())])
        signed = lambda h: pa.array(h.view(np.int64))
        k = (at - self.first[self.row[at]]).astype(np.int32)
        return [pa.array(self.row[at]), pa.array(k), pa.array(np.broadcast_to(n, at.shape).astype(np.int32)), keys, signed(self.left[at]), signed(self.right(at, n)), signed(gram[2])]


GRAM = "k int, n int, g binary, l long, r long, t long"


def _batches(flat: _Flat, ids, parts: Iterator) -> Iterator:
    import pyarrow as pa

    for at, n, gram in parts:
        row, *columns = flat.rows(at, n, gram)
        yield pa.RecordBatch.from_arrays([ids.take(row), *columns], ["sent_id", "k", "n", "g", "l", "r", "t"])


def short_n_grams(sentences: DataFrame) -> DataFrame:
    """``(sent_id, k, n, g, l, r, t)`` of every n-gram of 2 to ``SHORT`` usable tokens: place, length, key and hashes of neighbours and tags."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            flat = _Flat(batch.column(0), batch.column(1))

            def parts(flat=flat):
                gram = flat.hashes
                at = np.flatnonzero(flat.usable)
                gram = [h[at] for h in gram]
                for n in range(2, SHORT + 1):
                    kept = at + n <= flat.stop[at]
                    at, gram = at[kept], [g[kept] for g in gram]
                    if not len(at):
                        return
                    gram = [_mix(g, h[at + n - 1]) for g, h in zip(gram, flat.hashes)]
                    yield at, np.full(len(at), n), gram

            yield from _batches(flat, batch.column(0), parts())

    ids = sentences.schema["sent_id"].dataType.simpleString()
    return sentences.select("sent_id", "x").mapInArrow(run, f"sent_id {ids}, {GRAM}")


def n_grams_at(sentences: DataFrame, places: DataFrame) -> DataFrame:
    """The n-grams of the lengths ``low`` to ``high`` at the places ``(sent_id, k, low, high)``, as far as the usable tokens go.

    Hashes of the runs of 1, 2, 4, ... tokens give that of any length in a few steps.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            flat, asked = _Flat(batch.column(0), batch.column(1)), batch.column(2)
            rows = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy(zero_copy_only=False))
            k, low, high = (asked.flatten().field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("k", "low", "high"))
            at = flat.first[rows] + k
            high = np.minimum(high, flat.stop[at] - at)
            tables = [flat.hashes]
            for step in (1 << p for p in range(int(high.max(initial=1)).bit_length() - 1)):
                tables.append([_mix(h[: max(len(h) - step, 0)], h[step:]) for h in tables[-1]])

            def gram_of(at: np.ndarray, n: np.ndarray, tables=tables) -> list[np.ndarray]:
                found, done = [np.zeros(len(at), np.uint64) for _ in range(3)], np.zeros(len(at), np.int64)
                for p in range(len(tables) - 1, -1, -1):
                    has = np.flatnonzero(n >> p & 1)
                    for f, table in zip(found, tables[p]):
                        f[has] = _mix(f[has], table[(at + done)[has]])
                    done[has] += 1 << p
                return found

            def parts(at=at, low=low, high=high, gram_of=gram_of):
                count = np.maximum(0, high - low + 1)
                for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(count) >> 18)) + 1):
                    here = np.repeat(at[own], count[own])
                    n = np.arange(len(here)) - np.repeat(np.cumsum(count[own]) - count[own], count[own]) + np.repeat(low[own], count[own])
                    if len(here):
                        yield here, n, gram_of(here, n)

            yield from _batches(flat, batch.column(0), parts())

    ids = sentences.schema["sent_id"].dataType.simpleString()
    asked = places.groupBy("sent_id").agg(F.collect_list(F.struct("k", "low", "high")).alias("asked"))
    return sentences.select("sent_id", "x").join(asked, "sent_id").select("sent_id", "x", "asked").mapInArrow(run, f"sent_id {ids}, {GRAM}")


def _classes(grams: DataFrame) -> DataFrame:
    ends = [end(c).alias(f"{c}{k}") for c in "lrt" for k, end in ((1, F.min), (2, F.max))]
    return grams.groupBy("g").agg(F.count("*").alias("support"), *ends)


def long_n_grams(sentences: DataFrame, grams: DataFrame, classes: DataFrame) -> DataFrame | None:
    """The n-grams longer than ``SHORT`` that can be maximal repeats; none is there if this is None.

    An n-gram whose occurrences all have one left neighbour is no maximal repeat, and
    neither are its extensions. So at each place lengths count up to the longest with
    several left neighbours, which is found by bisection, all places at a time. Of a
    repeated passage that is the place of its begin alone. Where the places have little
    room up to the end of their sentences all lengths are taken, which costs less.
    """
    longest = F.col("n") == SHORT
    open_ = classes.where("l1 <> l2").select("g")
    places = checkpoint(grams.where(longest).join(open_, "g", "left_semi").select("sent_id", "k", F.lit(SHORT).alias("m")))
    if places.isEmpty():
        return None
    sizes = sentences.select("sent_id", F.size("x").alias("size"))
    room = places.join(sizes, "sent_id").agg(F.avg(F.col("size") - F.col("k") - SHORT).alias("room")).first().room
    if room <= ROOM:
        return n_grams_at(sentences, places.select("sent_id", "k", F.lit(SHORT + 1).alias("low"), F.lit((1 << 31) - 1).alias("high")))
    size = sizes.agg(F.max("size").alias("size")).first().size
    for p in range(max(size - SHORT, 1).bit_length() - 1, -1, -1):
        tried = n_grams_at(sentences, places.select("sent_id", "k", (F.col("m") + (1 << p)).alias("low"), (F.col("m") + (1 << p)).alias("high")))
        tried = checkpoint(tried.select("sent_id", "k", "g", "l"))
        several = tried.groupBy("g").agg(F.min("l").alias("l1"), F.max("l").alias("l2"), F.count("*").alias("support")).where("l1 <> l2").select("g", "support")
        reached = skew_join(tried.select("sent_id", "k", "g"), several, "g", heavy=_heavy(several, "g", "support"), right_unique=True).select("sent_id", "k", F.lit(1).alias("more"))
        places = checkpoint(places.join(reached, ["sent_id", "k"], "left").select("sent_id", "k", F.when(F.col("more") == 1, F.col("m") + (1 << p)).otherwise(F.col("m")).alias("m")))
    return n_grams_at(sentences, places.select("sent_id", "k", F.lit(SHORT + 1).alias("low"), F.col("m").alias("high")))


def variation_n_grams(tokens: DataFrame, form: str, label: str) -> DataFrame:
    """``(sent_id, pos, flag, corrected)``: tokens whose tag varies from the majority in a repeated n-gram.

    A maximal repeat is an n-gram, n > 1, with at least two occurrences, two left and two
    right neighbours; a sentence edge is a neighbour of its own. Where its tag sequences
    vary, tokens that differ from the most frequent sequence (ties: first by sentence and
    position) are flagged. If several repeats flag a token the correction is that of the
    rarest, ties to the last n-gram. Each occurrence counts once. Unflagged tokens keep
    their label as correction.

    N-grams are compared by 128-bit hashes and carry their place; tokens and tags are looked
    up again for the few that are flagged.
    """
    sentences = stored(hashed_sentences(tokens, form, label))
    grams = stored(short_n_grams(sentences))
    classes = checkpoint(_classes(grams).where("l1 <> l2"))
    longer = long_n_grams(sentences, grams, classes)
    if longer is not None:
        longer = stored(longer)
        grams, classes = grams.unionByName(longer), classes.unionByName(_classes(longer))
    varying = checkpoint(classes.where("l1 <> l2 and r1 <> r2 and t1 <> t2").select("g", "support"))
    heavy = checkpoint(_heavy(varying, "g", "support"))
    kept = checkpoint(skew_join(grams.select("g", "sent_id", "k", "n", "t"), varying, "g", heavy=heavy, right_unique=True))
    counts = kept.groupBy("g", "t").agg(F.count("*").alias("c"), F.min(F.struct("sent_id", "k")).alias("first"))
    rank = F.struct(F.col("c"), -F.col("first.sent_id"), -F.col("first.k"))
    best = counts.groupBy("g").agg(F.max_by(F.struct("t", "first"), rank).alias("best")).select("g", F.col("best.t").alias("best_t"), "best.first")
    wrong = checkpoint(skew_join(kept, best, "g", heavy=heavy, right_unique=True).where("t <> best_t"))
    words = sentences.select("sent_id", F.transform("x", lambda v: F.struct(v["pos"].alias("pos"), v["w"].alias("w"), v["y"].alias("y"))).alias("x"))
    models = wrong.groupBy("g").agg(F.first("first").alias("first"), F.first("n").alias("n")).select("g", "first.sent_id", "first.k", "n")
    tags = models.join(words, "sent_id").select("g", F.slice("x", F.col("k") + 1, F.col("n"))["y"].alias("tags"))
    found = skew_join(wrong.select("g", "sent_id", "k", "n", "support"), tags, "g", heavy=heavy, right_unique=True)
    own = found.join(words, "sent_id").withColumn("x", F.slice("x", F.col("k") + 1, F.col("n")))
    pair = F.explode(F.arrays_zip(F.col("x").alias("x"), F.col("tags").alias("tag"))).alias("p")
    each = own.select("sent_id", "support", F.array_join(F.col("x")["w"], SEPARATOR).alias("gram"), pair).where("p.x.y <> p.tag")
    last = F.max_by(F.col("p.tag"), F.struct(-F.col("support"), F.col("gram")))
    flagged = each.groupBy("sent_id", F.col("p.x.pos").alias("pos")).agg(last.alias("fix"))
    joined = tokens.select("sent_id", "pos", label).join(flagged, ["sent_id", "pos"], "left")
    return joined.select("sent_id", "pos", F.col("fix").isNotNull().alias("flag"), F.coalesce("fix", label).alias("corrected"))


def variation_n_grams_span(tokens: DataFrame, spans: DataFrame, form: str, k: int = 1) -> DataFrame:
    """``(sent_id, start_pos, end_pos, flag, corrected)``: spans whose type varies from its context's majority.

    The context is the span with k tokens on either side; ties go to the type first seen.
    ``spans`` has ``(sent_id, start_pos, end_pos, type)``, half open, positions from 0
    without gaps. Null tokens are contexts of their own kind.
    """
    words = unflatten(tokens.select("sent_id", "pos", F.coalesce(form, F.lit("\u0002")).alias("w")), ["w"])
    own = spans.select("sent_id", "start_pos", "end_pos", "type").join(words, "sent_id")
    begin = F.greatest(F.col("start_pos") - k, F.lit(0))
    window = F.slice("w", begin + 1, F.least(F.col("end_pos") + k, F.size("w")) - begin)
    keyed = own.select("sent_id", "start_pos", "end_pos", "type", F.array_join(window, SEPARATOR).alias("context"))
    counts = keyed.groupBy("context", "type").agg(F.count("*").alias("c"), F.min(F.struct("sent_id", "start_pos")).alias("first"))
    rank = F.struct(F.col("c"), -F.col("first.sent_id"), -F.col("first.start_pos"))
    best = counts.groupBy("context").agg(F.max_by("type", rank).alias("corrected"))
    joined = skew_join(keyed, best, "context", right_unique=True)
    return joined.select("sent_id", "start_pos", "end_pos", (F.col("type") != F.col("corrected")).alias("flag"), "corrected")
