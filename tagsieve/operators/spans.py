"""Spans of BIO-tagged sequences: extraction, matching, alignment and aggregation.

Spans are half open and non-overlapping within a tagging of a sentence. ``I-X`` after ``O``
or after another type begins a span; anything but ``B-`` and ``I-`` tags, null included, is
outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.operators.sequences import unflatten

#: Gold label of a noisy span that matches no gold span.
NO_ALIGNMENT = "___NO_ALIGNMENT___"


def bio_spans(tokens: DataFrame, tag: str) -> DataFrame:
    """``(sent_id, start_pos, end_pos, type)`` of every span of a tagging in long form."""
    kind = F.when(F.col(tag).rlike("^[BI]-"), F.substring(F.col(tag), 1, 1))
    rows = tokens.select("sent_id", "pos", kind.alias("b"), F.when(kind.isNotNull(), F.substring(tag, 3, 1 << 20)).alias("type"))
    sentence = Window.partitionBy("sent_id").orderBy("pos")
    begins = (F.col("b") == "B") | (~F.lag("type").over(sentence).eqNullSafe(F.col("type")))
    numbered = rows.withColumn("begins", F.when(F.col("b").isNotNull() & begins, 1).otherwise(0))
    numbered = numbered.withColumn("span", F.sum("begins").over(sentence)).where("b is not null")
    grouped = numbered.groupBy("sent_id", "span").agg(F.min("pos").alias("start_pos"), (F.max("pos") + 1).alias("end_pos"), F.first("type").alias("type"))
    return grouped.select("sent_id", "start_pos", "end_pos", "type")


def best_matching(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> dict[int, int]:
    """The pairs of overlapping spans with the largest total overlap, one to one.

    Both lists are ordered and free of overlaps, so the best pairs never cross, and the
    best matching of prefixes follows from shorter ones.
    """
    wide = len(b) + 1
    best = [0] * wide
    steps: list[list[int]] = []
    for begin, end in a:
        row, step = [0] * wide, [0] * wide
        for j, (other, stop) in enumerate(b, 1):
            shared = min(end, stop) - max(begin, other)
            row[j], step[j] = best[j], 0
            if shared > 0 and best[j - 1] + shared > row[j]:
                row[j], step[j] = best[j - 1] + shared, 1
            if row[j - 1] > row[j]:
                row[j], step[j] = row[j - 1], 2
        best = row
        steps.append(step)
    pairs, i, j = {}, len(a), len(b)
    while i and j:
        step = steps[i - 1][j]
        if step == 1:
            pairs[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif step == 2:
            j -= 1
        else:
            i -= 1
    return pairs


def match_spans(a: DataFrame, b: DataFrame, keep_a: bool = True) -> DataFrame:
    """``(sent_id, a, b)``: the matching of the spans of two taggings, as structs of the spans.

    With ``keep_a`` spans of ``a`` without a partner come out with a null ``b``. Spans pair
    within their sentence only, and each sentence is matched by itself.
    """
    span = F.struct("start_pos", "end_pos", "type")
    own = a.groupBy("sent_id").agg(F.array_sort(F.collect_list(span)).alias("a"))
    other = b.groupBy("sent_id").agg(F.array_sort(F.collect_list(span)).alias("b"))
    both = own.join(other, "sent_id", "left" if keep_a else "inner")

    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for xs, ys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ends = [[(s["start_pos"], s["end_pos"]) for s in spans or []] for spans in (xs, ys)]
                found = best_matching(*ends)
                rows.append([found.get(k) for k in range(len(xs))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], ["sent_id", "a", "b", "to"])

    ids = both.schema["sent_id"].dataType.simpleString()
    spans = f"array<{a.select(span).schema[0].dataType.simpleString()}>"
    matched = both.mapInArrow(match, f"sent_id {ids}, a {spans}, b {spans}, to array<int>")
    pairs = matched.select("sent_id", "b", F.explode(F.arrays_zip("a", "to")).alias("x"))
    result = pairs.select("sent_id", F.col("x.a").alias("a"), F.when(F.col("x.to").isNotNull(), F.get("b", F.col("x.to"))).alias("b"))
    return result if keep_a else result.where("b is not null")


def align_span_data(tokens: DataFrame, token: str, gold: str, noisy: str) -> DataFrame:
    """Noisy spans with their gold: ``(sent_id, start_pos, end_pos, surface_form, gold, noisy, gold_start, gold_end)``.

    The surface form is that of the gold span where there is one. A span without a partner
    has the gold label ``NO_ALIGNMENT`` and null gold bounds.
    """
    pairs = match_spans(bio_spans(tokens, noisy), bio_spans(tokens, gold))
    words = unflatten(tokens.select("sent_id", "pos", F.coalesce(token, F.lit("")).alias("w")), ["w"])
    joined = pairs.join(words, "sent_id")
    bounds = F.coalesce("b", "a")
    form = F.array_join(F.slice("w", bounds["start_pos"] + 1, bounds["end_pos"] - bounds["start_pos"]), " ")
    return joined.select(
        "sent_id",
        F.col("a.start_pos").alias("start_pos"),
        F.col("a.end_pos").alias("end_pos"),
        form.alias("surface_form"),
        F.coalesce("b.type", F.lit(NO_ALIGNMENT)).alias("gold"),
        F.col("a.type").alias("noisy"),
        F.col("b.start_pos").alias("gold_start"),
        F.col("b.end_pos").alias("gold_end"),
    )


def label_map(classes: DataFrame) -> DataFrame:
    """``(idx, type)``: the span type of every tag index; ``O`` is a type of its own."""
    return classes.select("idx", F.regexp_replace("label", "^[BI]-", "").alias("type"))


def span_probabilities(spans: DataFrame, probs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(sent_id, start_pos, end_pos, type, p)``: mean token probability, then mean over a type's tags.

    ``probs`` has ``(sent_id, pos, probs)`` by tag index, with a column ``t`` for repeated
    rows, which then stays. Nothing is rescaled. ``spans`` are those whose tokens count.
    """
    repeat = ["t"] if "t" in probs.columns else []
    bounds = spans.select("sent_id", "start_pos", "end_pos").alias("s")
    inside = probs.alias("p").join(bounds, (F.col("p.sent_id") == F.col("s.sent_id")) & (F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("end_pos")))
    long = inside.select("s.sent_id", "start_pos", "end_pos", *repeat, F.posexplode("probs").alias("idx", "p"))
    keys = ["sent_id", "start_pos", "end_pos", *repeat]
    by_tag = long.groupBy(*keys, "idx").agg(F.avg("p").alias("p"))
    return by_tag.join(F.broadcast(label_map(classes)), "idx").groupBy(*keys, "type").agg(F.avg("p").alias("p"))


def align_span_result(noisy: DataFrame, predicted: DataFrame, probs: DataFrame, classes: DataFrame, repeated: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Noisy spans with predictions, their probabilities and repeated ones.

    ``(sent_id, start_pos, end_pos, noisy, prediction)``; a span without a predicted
    partner is predicted ``O`` and takes the probabilities of its own tokens, others those
    of the partner's tokens.
    """
    pairs = match_spans(noisy, predicted)
    source = F.coalesce("b", "a")
    aligned = pairs.select(
        "sent_id", F.col("a.start_pos").alias("start_pos"), F.col("a.end_pos").alias("end_pos"), F.col("a.type").alias("noisy"),
        F.coalesce("b.type", F.lit("O")).alias("prediction"), source["start_pos"].alias("s"), source["end_pos"].alias("e"),
    )

    def reduced(rows: DataFrame) -> DataFrame:
        source = aligned.select("sent_id", F.col("s").alias("start_pos"), F.col("e").alias("end_pos")).distinct()
        found = span_probabilities(source, rows, classes).withColumnsRenamed({"start_pos": "s", "end_pos": "e"})
        return aligned.select("sent_id", "start_pos", "end_pos", "s", "e").join(found, ["sent_id", "s", "e"]).drop("s", "e")

    return aligned.drop("s", "e"), reduced(probs), None if repeated is None else reduced(repeated)


def aggregate_scores(spans: DataFrame, scores: DataFrame, aggregate=F.avg) -> DataFrame:
    """``(sent_id, start_pos, end_pos, type, score)``: token scores ``(sent_id, pos, score)`` over each span."""
    joined = spans.alias("s").join(
        scores.alias("t"), (F.col("s.sent_id") == F.col("t.sent_id")) & (F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("end_pos"))
    )
    return joined.groupBy("s.sent_id", "start_pos", "end_pos", "type").agg(aggregate("score").alias("score"))


def embed_spans(spans: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(sent_id, start_pos, end_pos, type, vec)``: the mean of the token vectors ``(sent_id, pos, vec)``."""
    long = vectors.select("sent_id", "pos", F.posexplode("vec").alias("dim", "x")).alias("t")
    joined = spans.alias("s").join(long, (F.col("s.sent_id") == F.col("t.sent_id")) & (F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("end_pos")))
    means = joined.groupBy("s.sent_id", "start_pos", "end_pos", "type", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"])
    return means.groupBy("sent_id", "start_pos", "end_pos", "type").agg(ordered.alias("vec"))


def _sentences_of(tokens: DataFrame, run: Callable, columns: list[Column], schema: str) -> DataFrame:
    """``run`` over Arrow tables of whole sentences in their order, whose column ``place`` counts from 1 in each.

    Rows that lie by sentence already aren't shuffled again. ``columns`` are made after the sort.
    """
    place = F.row_number().over(Window.partitionBy("sent_id").orderBy("pos"))
    rows = tokens.where("sent_id is not null and pos is not null").withColumn("__place", place).select("sent_id", "pos", F.col("__place").alias("place"), *columns)

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        waiting: list = []
        for batch in batches:
            first = np.flatnonzero(batch.column("place").to_numpy() == 1)
            cut = int(first[-1]) if len(first) else 0
            if cut or len(first) and waiting:
                yield from run(pa.Table.from_batches([*waiting, batch.slice(0, cut)]).combine_chunks())
                waiting = []
            waiting.append(batch.slice(cut))
        if any(b.num_rows for b in waiting):
            yield from run(pa.Table.from_batches(waiting).combine_chunks())

    return rows.mapInArrow(whole, schema)


def _runs(tags, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """First row and row after the last of every span of a column of tags, and the types."""
    coded = tags.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if hasattr(coded, "chunks") else coded
    values = coded.dictionary.to_pylist()
    spans = [v is not None and v[:2] in ("B-", "I-") for v in values]
    names = list(dict.fromkeys(v[2:] for v, x in zip(values, spans) if x))
    at = {n: k for k, n in enumerate(names)}
    code = coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)
    kind = np.array([*(at[v[2:]] if x else -1 for v, x in zip(values, spans)), -1])[code]
    begin = np.array([*(x and v[0] == "B" for v, x in zip(values, spans)), False])[code] | first
    begin[1:] |= kind[1:] != kind[:-1]
    begin &= kind >= 0
    starts = np.flatnonzero(begin)
    bounds = np.append(np.flatnonzero(begin | (kind < 0)), len(kind))
    return starts, bounds[np.searchsorted(bounds, starts, "right")], [names[k] for k in kind[starts]]


def _partners(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], size: int) -> np.ndarray:
    """The index in ``b`` of each span of ``a``, or -1; both are sentence number, start and end, in order. See ``best_matching``."""
    count_a, count_b = np.bincount(a[0], minlength=size), np.bincount(b[0], minlength=size)
    from_a, from_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    alike = count_a == count_b
    to = from_b[a[0]] + np.arange(len(a[0])) - from_a[a[0]]
    there = np.flatnonzero(alike[a[0]])
    other = to[there]
    alike[a[0][there[(a[1][there] != b[1][other]) | (a[2][there] != b[2][other])]]] = False
    to[~alike[a[0]]] = -1
    for k in np.flatnonzero(~alike & (count_a > 0) & (count_b > 0)):
        own, its = slice(from_a[k], from_a[k] + count_a[k]), slice(from_b[k], from_b[k] + count_b[k])
        found = best_matching(list(zip(a[1][own].tolist(), a[2][own].tolist())), list(zip(b[1][its].tolist(), b[2][its].tolist())))
        for x, y in found.items():
            to[from_a[k] + x] = from_b[k] + y
    return to


def _means(lists, begin: np.ndarray, end: np.ndarray, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lists in rows ``begin`` to ``end``: their mean by place, where it isn't null, and the longest length.

    Null elements count neither in the mean nor in its number; ``width`` leaves out later places.
    """
    lists = lists.combine_chunks()
    lists = lists.combine_chunks() if hasattr(lists, "chunks") else lists
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    known = np.asarray(flat.is_valid().to_numpy(zero_copy_only=False))
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    wide = int(size.max(initial=0))
    if (size == wide).all():
        x, n = values.reshape(len(size), wide), known.reshape(len(size), wide)
    else:
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
        x, n = np.zeros((len(size), wide)), np.zeros((len(size), wide), bool)
        x[row, place], n[row, place] = values, known
    x, n = x[:, :width], n[:, :width]
    cuts = np.column_stack([begin, end]).ravel()

    def over(operation: np.ufunc, array: np.ndarray) -> np.ndarray:
        return operation.reduceat(np.concatenate([array, np.zeros_like(array[:1])]), cuts, axis=0)[::2]

    number = over(np.add, n.astype(np.int64))
    with np.errstate(invalid="ignore", divide="ignore"):
        return over(np.add, x) / number, number > 0, over(np.maximum, size)


def _same_places(pos: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the first row, and the row after the last, of its sentence that has its ``pos``."""
    change = first.copy()
    change[1:] |= pos[1:] != pos[:-1]
    at = np.flatnonzero(change)
    number = np.cumsum(change) - 1
    return at[number], np.append(at[1:], len(pos))[number]


def align_tagged_result(tokens: DataFrame, noisy: str, predicted: str, probs: Column | dict[int, Column], classes: DataFrame) -> DataFrame:
    """The probabilities of ``align_span_result`` of two taggings and probabilities that are columns of the same rows.

    ``(sent_id, start_pos, end_pos, type, p)``, or with ``t`` before the type if ``probs`` has
    a column for each ``t``. A row goes to its sentence once, if it doesn't lie there
    already, without ``probs``, which are made there; ``align_span_result`` takes spans and
    probabilities from anywhere.
    """
    turns, lists = (list(probs), list(probs.values())) if isinstance(probs, dict) else ([None], [probs])
    of_type: dict[str | None, list[int]] = {}
    for r in label_map(classes).where("idx >= 0").collect():
        of_type.setdefault(r["type"], []).append(r["idx"])
    width = max((i + 1 for own in of_type.values() for i in own), default=0)
    kinds = {c: tokens.schema[c].dataType.simpleString() for c in ("sent_id", "pos")}
    repeat = ["t"] if isinstance(probs, dict) else []
    schema = f"sent_id {kinds['sent_id']}, start_pos {kinds['pos']}, end_pos {kinds['pos']}, " + ("t int, " if repeat else "") + "type string, p double"

    def run(table) -> Iterator:
        import pyarrow as pa

        first, pos = table["place"].to_numpy() == 1, table["pos"].to_numpy()
        begin, end, _ = _runs(table["noisy"], first)
        if not len(begin) or not width:
            return
        start, stop = pos[begin], pos[end - 1] + 1
        other, its_end, _ = _runs(table["predicted"], first)
        number = np.cumsum(first) - 1
        to = _partners((number[begin], start, stop), (number[other], pos[other], pos[its_end - 1] + 1), int(number[-1]) + 1)
        left, right = _same_places(pos, first)
        if len(other):
            own = np.where(to >= 0, other[to], begin), np.where(to >= 0, its_end[to], end)
        else:
            own = begin, end
        for k, t in enumerate(turns):
            means, known, size = _means(table[f"probs_{k}"], left[own[0]], right[own[1] - 1], width)
            for name, places in of_type.items():
                there = [i for i in places if i < means.shape[1]]
                if not there:
                    continue
                has = np.flatnonzero(size > min(there))
                n = known[has][:, there].sum(axis=1)
                p = np.where(known[has][:, there], means[has][:, there], 0.0).sum(axis=1) / np.maximum(n, 1)
                columns = [table["sent_id"].take(pa.array(begin[has])), pa.array(start[has]), pa.array(stop[has]), *([pa.array([t] * len(has), pa.int32())] if repeat else [])]
                found = pa.table([*columns, pa.array([name] * len(has), pa.string()), pa.array(p, mask=n == 0)], names=["sent_id", "start_pos", "end_pos", *repeat, "type", "p"])
                yield from found.to_batches()

    columns = [F.col(noisy).alias("noisy"), F.col(predicted).alias("predicted"), *(p.cast("array<double>").alias(f"probs_{k}") for k, p in enumerate(lists))]
    return _sentences_of(tokens, run, columns, schema)


def embed_tagged(tokens: DataFrame, tag: str, vector: Column) -> DataFrame:
    """``embed_spans`` of a tagging and vectors that are columns of the same rows: ``(sent_id, start_pos, end_pos, type, vec)``.

    A row goes to its sentence once, if it doesn't lie there already, without its vector, which is made there.
    """
    kinds = {c: tokens.schema[c].dataType.simpleString() for c in ("sent_id", "pos")}
    schema = f"sent_id {kinds['sent_id']}, start_pos {kinds['pos']}, end_pos {kinds['pos']}, type string, vec array<double>"

    def run(table) -> Iterator:
        import pyarrow as pa

        first, pos = table["place"].to_numpy() == 1, table["pos"].to_numpy()
        begin, end, types = _runs(table["tag"], first)
        if not len(begin):
            return
        left, right = _same_places(pos, first)
        means, known, size = _means(table["vec"], left[begin], right[end - 1])
        has = np.flatnonzero(size > 0)
        inside = np.arange(means.shape[1]) < size[has][:, None]
        vec = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[has])), pa.int32()), pa.array(means[has][inside], mask=~known[has][inside]))
        found = pa.table(
            [table["sent_id"].take(pa.array(begin[has])), pa.array(pos[begin[has]]), pa.array(pos[end[has] - 1] + 1), pa.array([types[k] for k in has], pa.string()), vec],
            names=["sent_id", "start_pos", "end_pos", "type", "vec"],
        )
        yield from found.to_batches()

    return _sentences_of(tokens, run, [F.col(tag).alias("tag"), vector.cast("array<double>").alias("vec")], schema)


def is_error(gold: Column, noisy: Column) -> Column:
    """Whether a label is wrong; null labels are no error."""
    return F.coalesce(gold != noisy, F.lit(False))
