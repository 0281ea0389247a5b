"""Gradient-boosted trees over sparse counts, for all labels and folds at once.

The trees are those of Spark's ``GBTClassifier``, one binary model a label against the rest: the first fits
the labels as -1 and 1, each further one the slope of the logistic loss, by variance, and counts a tenth.
Its splits lie between all values that a fold's training rows have, where Spark takes those of a sample of
about 10,000 rows. Features of over ``BINS`` values get bins of about as many rows each, as there.

A level of the trees of all models is one pass over the rows. Of two siblings only the one with fewer rows is
counted, the other is their parent less that one. Sums are of whole numbers, ``ONE`` for 1, so that they are
exact and the same in any partitioning.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.plans.runtime import stored

BINS = 32
DEPTH = 4
STEP = 0.1
ONE = float(1 << 32)
#: Rows of one fold that a block has before it is written; at most a batch more.
BLOCK_ROWS = 1 << 14
#: Bytes of sums that the driver gets from the tasks of one pass and holds, at most; models beyond that are grown later.
PASS_BYTES = 128 << 20
#: Bytes of scores that one worker keeps from pass to pass; those that it lacks are added up again from the trees.
KEPT_BYTES = 256 << 20
_KEPT: OrderedDict[tuple[str, str], tuple[int, np.ndarray]] = OrderedDict()


def sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row begins, and all features and counts, of a column of sparse vectors."""
    lists = column.field("indices")
    at = lists.offsets.to_numpy()
    inner = slice(at[0], at[-1])
    return at - at[0], lists.values.to_numpy(zero_copy_only=False)[inner], column.field("values").values.to_numpy(zero_copy_only=False)[inner]


def _keys(index: np.ndarray, value: np.ndarray) -> np.ndarray:
    return index.astype(np.int64) << 32 | value.astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(fold, kind, key, n)``: rows of each label (kind 0), and of each feature and count (kind 1)."""
    for batch in batches:
        begins, index, value = sparse(batch.column("features"))
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        for f in np.unique(fold):
            own = fold == f
            pairs = _keys(index, value)[np.repeat(own, np.diff(begins))]
            for kind, keys in ((0, batch.column("y").to_numpy(zero_copy_only=False)[own]), (1, pairs)):
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_pydict({"fold": pa.array(np.full(len(key), f), pa.int32()), "kind": pa.array(np.full(len(key), kind), pa.int32()), "key": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64())})


def cuts(values: np.ndarray, n: np.ndarray) -> list[int]:
    """Positions in the ascending ``values`` at which a bin begins, but the first: all, or as many of about as many rows each."""
    if len(values) <= BINS:
        return list(range(1, len(values)))
    stride, found = n.sum() / BINS, []
    sums, target = np.cumsum(n), n.sum() / BINS
    for k in range(1, len(values)):
        if abs(sums[k - 1] - target) < abs(sums[k] - target):
            found.append(k)
            target += stride
    return found


class Codes:
    """All pairs of a feature and a count above 0, numbered: a row has at most one code a feature."""

    def __init__(self, seen: list[int]):
        self.keys = np.array(sorted(seen), np.int64)
        self.feature, self.value = self.keys >> 32, (self.keys & 0xFFFFFFFF).astype(float)
        self.first = np.flatnonzero(np.diff(self.feature, prepend=-1))
        sizes = np.diff(np.append(self.first, len(self.keys)))
        self.end = np.repeat(self.first + sizes, sizes)

    def splits(self, n: np.ndarray, rows: int) -> np.ndarray:
        """The threshold below each code that may begin the right side of a split, as ``n`` of ``rows`` training rows have it; else NaN."""
        out = np.full(len(n), np.nan)
        for begin in self.first:
            own = np.arange(begin, self.end[begin])[n[begin : self.end[begin]] > 0]
            values, each = self.value[own], n[own]
            if each.sum() < rows:
                own, values, each = np.append(-1, own), np.append(0.0, values), np.append(rows - each.sum(), each)
            at = np.array(cuts(values, each), int)
            out[own[at]] = (values[at - 1] + values[at]) / 2
        return out

    def of(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, _keys(index, value))


def _blocks(codes: Codes) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(fold: int) -> pa.RecordBatch:
            y, length, code = (np.concatenate(x) for x in zip(*waiting.pop(fold)))
            begins = np.concatenate([[0], np.cumsum(length)])
            return pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "fold": pa.array([fold], pa.int32()), "y": [y.astype(np.int32).tobytes()], "begins": [begins.astype(np.int32).tobytes()], "codes": [code.astype(np.int32).tobytes()]})

        for batch in batches:
            begins, index, value = sparse(batch.column("features"))
            fold, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y"))
            code, row = codes.of(index, value), np.repeat(np.arange(len(y)), np.diff(begins))
            length = np.diff(begins)
            for f in np.unique(fold).tolist():
                own = fold == f
                waiting.setdefault(f, []).append((y[own], length[own], code[own[row]]))
                if sum(len(part[0]) for part in waiting[f]) >= BLOCK_ROWS:
                    yield block(f)
        for f in list(waiting):
            yield block(f)

    return pack


def places(rows: int, depth: int, right: Callable[[int], np.ndarray]) -> np.ndarray:
    """The place of each row within a tree's level; ``right`` gives the rows that a node's split sends to the right."""
    place = np.zeros(rows, np.uint8)
    for level in range(depth):
        moved = np.zeros(rows, np.uint8)
        for k in range(1 << level):
            to_right = right((1 << level) - 1 + k)
            if len(to_right):
                moved[to_right[place[to_right] == k] if level else to_right] = 1
        place = 2 * place + moved
    return place


class Block:
    """Rows of one fold, by row and by code."""

    def __init__(self, name: str, fold: int, y: bytes, begins: bytes, codes: bytes, width: int):
        self.name, self.fold = name, fold
        self.y, self.begins, self.codes = (np.frombuffer(x, np.int32) for x in (y, begins, codes))
        self.rows = len(self.y)
        order = np.argsort(self.codes.astype(np.uint16) if width <= 1 << 16 else self.codes, kind="stable")
        self.by_code = np.repeat(np.arange(self.rows), np.diff(self.begins))[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.codes, minlength=width))])
        self.present = np.flatnonzero(np.diff(self.starts))

    def places(self, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        return places(self.rows, depth, lambda node: self.by_code[self.starts[low[node]] : self.starts[high[node]]])

    def sums(self, w: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width, np.int64)
        if len(self.present):
            out[self.present] = np.add.reduceat(w[self.by_code], self.starts[self.present])
        return out

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of some rows, and how many each has."""
        length = self.begins[rows + 1] - self.begins[rows]
        ends = np.cumsum(length)
        return self.codes[np.repeat(self.begins[rows] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)], length


class Pass:
    """What the tasks need for one level: the models, their whole trees, the tree that grows and the nodes to count."""

    def __init__(self, run: str, width: int, folds: np.ndarray, labels: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray, level: int, slots: np.ndarray):
        self.run, self.width, self.folds, self.labels, self.trees, self.low, self.high, self.level, self.slots = run, width, folds, labels, trees, low, high, level, slots

    def scores(self, block: Block, models: np.ndarray) -> np.ndarray:
        done, scores = _KEPT.pop((self.run, block.name), (0, None))
        if scores is None or done > len(self.trees):
            done, scores = 0, np.zeros((len(models), block.rows))
        for low, high, value in self.trees[done:]:
            for own, m in zip(scores, models):
                own += value[m][block.places(low[m], high[m], DEPTH)]
        _KEPT[self.run, block.name] = len(self.trees), scores
        while sum(x.nbytes for _, x in _KEPT.values()) > KEPT_BYTES:
            _KEPT.popitem(last=False)
        return scores

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, width = 1 << max(self.level - 1, 0), self.width
        sums, rows = np.zeros((len(self.folds), count, width), np.int64), np.zeros((len(self.folds), count, width if self.level else 0), np.int64)
        total = np.zeros((len(self.folds), count), np.int64)
        for batch in batches:
            for x in batch.to_pylist():
                block = Block(x["block"], x["fold"], x["y"], x["begins"], x["codes"], width)
                models = np.flatnonzero(self.folds != block.fold)
                scores = self.scores(block, models) if self.trees else [None] * len(models)
                for m, score in zip(models, scores):
                    sign = np.where(block.y == self.labels[m], 1.0, -1.0)
                    w = np.rint(ONE * (sign if score is None else 4 * sign / (1 + np.exp(2 * sign * score))))
                    if not self.level:
                        sums[m, 0] += block.sums(w, width)
                        total[m, 0] += int(w.sum())
                        continue
                    slot = self.slots[m][block.places(self.low[m], self.high[m], self.level)]
                    chosen = np.flatnonzero(slot >= 0)
                    if not len(chosen):
                        continue
                    codes, length = block.entries(chosen)
                    slot, w = slot[chosen], w[chosen]
                    keys = codes + width * np.repeat(slot, length)
                    rows[m] += np.bincount(keys, minlength=count * width).reshape(count, width)
                    sums[m] += np.bincount(keys, np.repeat(w, length), count * width).astype(np.int64).reshape(count, width)
                    total[m] += np.bincount(slot, w, count).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()], "rows": [rows.astype(np.int32).tobytes()], "total": [total.tobytes()]})


def _right_of(x: np.ndarray, codes: Codes) -> np.ndarray:
    """For each code, ``x`` summed over it and the later ones of its feature; whole numbers, so that overflows on the way cancel out."""
    sums = np.concatenate([np.zeros((*x.shape[:-1], 1), np.int64), np.cumsum(x, axis=-1)], axis=-1)
    return sums[..., codes.end] - sums[..., :-1]


def _grow(blocks: DataFrame, codes: Codes, counts: dict[int, np.ndarray], folds: np.ndarray, labels: np.ndarray, sizes: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(feature, threshold, value)`` of the models, by tree, model and node or leaf; a node without a split has feature -1."""
    run, width, size = uuid.uuid4().hex, len(codes.keys), len(folds)
    everything = sum(counts.values())
    root = np.stack([everything - counts.get(int(f), 0) for f in folds])
    by_fold = {f: codes.splits(everything - counts.get(f, 0), rows) for f, rows in set(zip(folds.tolist(), sizes.tolist()))}
    splits = np.stack([by_fold[f] for f in folds.tolist()])
    grown, found = [], []
    for tree in range(trees):
        nodes = (1 << DEPTH + 1) - 1
        n, total = np.zeros((size, nodes), np.int64), np.zeros((size, nodes), np.int64)
        low, high, feature, threshold = (np.full((size, (1 << DEPTH) - 1), x) for x in (0, 0, -1, 0.0))
        slots = np.zeros((size, 1), np.int64)
        for level in range(DEPTH):
            first, wide = (1 << level) - 1, 1 << level
            step = Pass(run, width, folds, labels, grown, low, high, level, slots)
            parts = blocks.mapInArrow(step, "sums binary, rows binary, total binary").collect() if (slots >= 0).any() else []
            if not level:
                sums = sum(np.frombuffer(p.sums, np.int64).reshape(size, 1, width) for p in parts)
                rows = root[:, None, :]
                n[:, 0], total[:, 0] = sizes, sum(np.frombuffer(p.total, np.int64).reshape(size, 1) for p in parts)[:, 0]
            else:
                half = wide // 2
                small_sums, small_rows, small_total = np.zeros((size, half, width), np.int64), np.zeros((size, half, width), np.int64), np.zeros((size, half), np.int64)
                for p in parts:
                    small_sums += np.frombuffer(p.sums, np.int64).reshape(size, half, width)
                    small_rows += np.frombuffer(p.rows, np.int32).reshape(size, half, width)
                    small_total += np.frombuffer(p.total, np.int64).reshape(size, half)
                small_left = (slots[:, ::2] >= 0)[..., None]
                small_right = (slots[:, 1::2] >= 0)[..., None]
                pair = lambda small, whole: np.stack([np.where(small_left, small, whole - small), np.where(small_right, small, np.where(small_left, whole - small, 0))], axis=2).reshape(size, wide, -1)
                sums, rows = pair(small_sums, sums), pair(small_rows, rows)
                total[:, first : first + wide] = pair(small_total[..., None], total[:, first - half : first, None])[..., 0]
            slots = np.full((size, 2 * wide), -1)
            for m in range(size if width else 0):
                right_n, right_s = _right_of(rows[m], codes), _right_of(sums[m], codes)
                whole_n, whole_s = n[m, first : first + wide, None], total[m, first : first + wide, None]
                left_n = whole_n - right_n
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = ((whole_s - right_s) / ONE) ** 2 / left_n + (right_s / ONE) ** 2 / right_n - (whole_s / ONE) ** 2 / whole_n
                gain = np.where((left_n > 0) & (right_n > 0) & ~np.isnan(splits[m]), gain, 0)
                for k, c in enumerate(gain.argmax(axis=1)):
                    node, left = first + k, 2 * (first + k) + 1
                    if gain[k, c] > 1e-12 * n[m, node]:
                        low[m, node], high[m, node], feature[m, node], threshold[m, node] = c, codes.end[c], codes.feature[c], splits[m, c]
                        n[m, left], n[m, left + 1] = left_n[k, c], right_n[k, c]
                        total[m, left], total[m, left + 1] = total[m, node] - right_s[k, c], right_s[k, c]
                        slots[m, 2 * k + int(n[m, left + 1] < n[m, left])] = k
                    else:
                        n[m, left], total[m, left] = n[m, node], total[m, node]
            if not width:
                n[:, 2 * first + 1 : 2 * (first + wide) : 2], total[:, 2 * first + 1 : 2 * (first + wide) : 2] = n[:, first : first + wide], total[:, first : first + wide]
        leaves = slice((1 << DEPTH) - 1, None)
        value = total[:, leaves] / ONE / np.maximum(n[:, leaves], 1) * (STEP if tree else 1.0)
        grown.append((low, high, value))
        found.append((feature, threshold, value))
    return tuple(np.stack(x) for x in zip(*found))


def fit(rows: DataFrame, k: int, labels: int, trees: int, few: Callable[[DataFrame], DataFrame]) -> list[tuple[dict[int, float], dict[int, tuple]]]:
    """For each of ``k`` folds, what its models have learned on ``(fold, y, features)`` of the other folds.

    A label without training rows, or with all of them, has a probability; the others have trees.
    ``few`` puts the rows in no more tasks than they fill.
    """
    counted = rows.mapInArrow(_counted, "fold int, kind int, key long, n long").groupBy("fold", "kind", "key").agg(F.sum("n").alias("n")).collect()
    by_label: dict[int, np.ndarray] = {}
    for r in counted:
        if not r.kind:
            by_label.setdefault(r.fold, np.zeros(labels, np.int64))[r.key] = r.n
    whole = sum(by_label.values(), np.zeros(labels, np.int64))
    codes = Codes(list({r.key for r in counted if r.kind}))
    counts = {}
    for f in by_label:
        key, n = np.array([(r.key, r.n) for r in counted if r.kind and r.fold == f], np.int64).reshape(-1, 2).T
        counts[f] = np.zeros(len(codes.keys), np.int64)
        counts[f][codes.of(key >> 32, key & 0xFFFFFFFF)] = n
    trained = [whole - by_label.get(f, 0) for f in range(k)]
    models = [(f, y) for f in range(k) for y in range(labels) if 0 < trained[f][y] < trained[f].sum()]
    found: list[tuple[dict, dict]] = [({y: float(trained[f][y] > 0) for y in range(labels) if (f, y) not in models}, {}) for f in range(k)]
    if not models:
        return found
    blocks = stored(few(rows).mapInArrow(_blocks(codes), "block string, fold int, y binary, begins binary, codes binary"))
    each = (12 * (1 << DEPTH - 2) * blocks.rdd.getNumPartitions() + 16 * (1 << DEPTH)) * max(1, len(codes.keys))
    size = max(1, PASS_BYTES // each)
    for at in range(0, len(models), size):
        folds, names = (np.array(x) for x in zip(*models[at : at + size]))
        grown = _grow(blocks, codes, counts, folds, names, np.array([trained[f].sum() for f in folds]), trees)
        for m, (f, y) in enumerate(models[at : at + size]):
            found[f][1][y] = tuple(x[:, m] for x in grown)
    return found


def probabilities(learned: tuple[dict[int, float], dict[int, tuple]], begins: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A row of probabilities, one a label against the rest, for each row of sparse counts."""
    fixed, models = learned
    rows = len(begins) - 1
    out = np.zeros((rows, len(fixed) + len(models)))
    for y, p in fixed.items():
        out[:, y] = p
    order = np.argsort(index, kind="stable")
    row, value, index = np.repeat(np.arange(rows), np.diff(begins))[order], value[order], index[order]

    def right(feature: int, threshold: float) -> np.ndarray:
        if feature < 0:
            return row[:0]
        a, b = np.searchsorted(index, [feature, feature + 1])
        return row[a:b][value[a:b] > threshold]

    for y, (features, thresholds, values) in models.items():
        score = np.zeros(rows)
        for feature, threshold, leaves in zip(features, thresholds, values):
            score += leaves[places(rows, DEPTH, lambda node: right(feature[node], threshold[node]))]  # noqa: B023
        out[:, y] = 1 / (1 + np.exp(-2 * score))
    return out
