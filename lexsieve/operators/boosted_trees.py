"""Gradient-boosted regression trees on sparse rows, grown level by level from histograms.

The method is that of ``pyspark.ml``: the first tree fits the signs of the classes, every other one the negative gradient of
``2 log(1 + exp(-2 y F))``; splits lessen the variance most, among at most 32 bins of each feature with its thresholds between
distinct values. ``pyspark.ml`` lays out every row with a bin for each of its features; here a row holds only the bins of values that
are not in the bin of zero, and the sums of that bin are what the others leave of a node.

Rows are packed once. A scan adds up counts and residuals of all open nodes by bins in the tasks; the sums meet by ranges of features in a
shuffle, where the best split of every node in the range is found, so only one row a node and range reaches the driver. Residuals
come from the trees since the margins were last written with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.operators.linear_solver import BLOCK_ENTRIES, PART_BYTES, sparse_rows
from lexsieve.plans.scale import written

BINS = 32
#: Rows of one block and bins of one range of features, some more where a feature straddles the end.
BLOCK_ROWS, RANGE_BINS = 8192, 1 << 16
#: Trees after which the margins are written with the rows.
REFRESH = 25
#: Gains nearer than this share count as equal, the first feature and threshold wins; gains below the other are none.
SAME, LEAST = 1e-9, 1e-12


@dataclass(frozen=True)
class Bins:
    """Bins of all features in one numbering: feature f has those from base[f] on, zero[f] is the bin of the value 0."""

    base: np.ndarray
    zero: np.ndarray
    thresholds: np.ndarray  # threshold of the upper end of a bin, infinite for a feature's last

    def of(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = self.base[feature].astype(np.int32)
        for _ in range(BINS):
            above = value > self.thresholds[out]
            if not above.any():
                break
            out += above
        return out


def thresholds_between(values: list[float], counts: list[float], rows: float, most: int) -> list[float]:
    """Thresholds of one feature from its sorted distinct values, as ``pyspark.ml`` places them."""
    if len(values) - 1 <= most:
        return [(a + b) / 2.0 for a, b in zip(values[:-1], values[1:])]
    stride, seen, out = rows / (most + 1), counts[0], []
    goal = stride
    for k in range(1, len(values)):
        before, seen = seen, seen + counts[k]
        if abs(before - goal) < abs(seen - goal):
            out.append((values[k - 1] + values[k]) / 2.0)
            goal += stride
    return out


def find_bins(rows: DataFrame, n_rows: int, size: int, features: str = "features") -> Bins:
    """Bins of all features, from all rows; only thresholds come to the driver."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, index, value = sparse_rows(batch.column(0))
            if not np.isfinite(value).all():
                raise ValueError("a feature is not finite")
            some = value != 0
            pair = np.empty(int(some.sum()), [("f", np.int64), ("v", np.float64)])
            pair["f"], pair["v"] = index[some], value[some]
            found, count = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found["f"])), pa.array(np.ascontiguousarray(found["v"])), pa.array(count)], ["f", "v", "n"])

    most = min(BINS, n_rows) - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs in batch.column(1).to_pylist():
                known = {p["v"]: float(p["n"]) for p in pairs}
                if (zeros := n_rows - sum(known.values())) > 0:
                    known[0.0] = zeros
                values = sorted(known)
                out.append(thresholds_between(values, [known[v] for v in values], n_rows, most))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["f", "t"])

    counted = rows.select(features).mapInArrow(entries, "f long, v double, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    per_feature = counted.groupBy("f").agg(F.collect_list(F.struct("v", "n")).alias("pairs"))
    found = per_feature.mapInArrow(place, "f long, t array<double>").toArrow()
    order = np.argsort(found["f"].to_numpy())
    found = found.take(pa.array(order))
    own, lists = found["f"].to_numpy(), found["t"].combine_chunks()
    counts = np.zeros(size, np.int64)
    counts[own] = lists.value_lengths().to_numpy()
    base = np.concatenate(([0], np.cumsum(counts + 1)))
    thresholds = np.full(base[-1], np.inf)
    last = np.zeros(base[-1], bool)
    last[base[1:] - 1] = True
    thresholds[~last] = lists.flatten().to_numpy()
    zero = base[:-1] + np.add.reduceat((thresholds < 0).astype(np.int64), base[:-1]) if size else base[:-1]
    return Bins(base, zero, thresholds)


@dataclass
class Tree:
    """Nodes in heap order: the feature of an inner node (-1: none), the last bin that goes left, the value of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    weight: float

    @classmethod
    def empty(cls, depth: int, weight: float) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n), np.zeros(n), weight)

    def nodes(self, laid: np.ndarray, column: dict[int, int], rows: int) -> np.ndarray:
        """Node of each row, whose used features are laid out densely."""
        own = np.array([column.get(f, -1) for f in self.feature.tolist()])
        node = np.zeros(rows, np.int64)
        while True:
            at = own[node]
            inner = np.flatnonzero(at >= 0)
            if not len(inner):
                return node
            below = node[inner]
            node[inner] = 2 * below + 1 + (laid[inner, at[inner]] > self.cut[below])


def _used(trees: list[Tree]) -> dict[int, int]:
    used = np.unique(np.concatenate([t.feature for t in trees])) if trees else np.zeros(0, np.int64)
    return {int(f): k for k, f in enumerate(used[used >= 0])}


def _laid(lengths: np.ndarray, entries: np.ndarray, column_of: np.ndarray, values: np.ndarray, default: np.ndarray) -> np.ndarray:
    """The used features of each row, from the entries that have a column."""
    out = np.tile(default, (len(lengths), 1))
    at = column_of[entries]
    some = np.flatnonzero(at >= 0)
    out[np.repeat(np.arange(len(lengths)), lengths)[some], at[some]] = values[some]
    return out


NAMES = ["pointers", "bins", "label", "margin"]
_KINDS = [np.int64, np.int32, np.int64, np.float64]


def _parts(blocks: DataFrame) -> DataFrame:
    size = blocks.agg(F.sum(sum((F.octet_length(n) for n in NAMES), F.lit(0).cast("long")))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    return blocks.coalesce(parts) if parts < blocks.rdd.getNumPartitions() else blocks


def _packed(rows: DataFrame, label: str, bins, features: str = "features") -> DataFrame:
    """Blocks of rows without margins; values in the bin of zero are left out."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Bins = bins.value
        for batch in batches:
            pointers, index, value = sparse_rows(batch.column(1))
            slot = own.of(index, value)
            kept = slot != own.zero[index]
            pointers = np.concatenate(([0], np.cumsum(kept)))[pointers]
            slot, codes = slot[kept], batch.column(0).to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(pointers, pointers[at] + BLOCK_ENTRIES, side="right")) - 1)
                to = min(to, at + BLOCK_ROWS, batch.num_rows)
                a, b = pointers[at], pointers[to]
                fields = (pointers[at:to + 1] - a, slot[a:b], codes[at:to], np.zeros(to - at))
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(f).tobytes()], pa.binary()) for f in fields], NAMES)
                at = to

    chosen = rows.select(F.col(label).cast("long").alias("label"), F.col(features).alias("features"))
    return _parts(written(chosen.mapInArrow(pack, ", ".join(f"{n} binary" for n in NAMES)), "instances"))


class _Rows:
    """One block with the nodes of its rows in any tree of a list."""

    def __init__(self, batch: pa.RecordBatch, row: int, trees: list[Tree], bins: Bins) -> None:
        self.pointers, self.slot, self.label, self.margin = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate(_KINDS))
        self.lengths, self.column = np.diff(self.pointers), _used(trees)
        column_of = np.full(len(bins.thresholds), -1, np.int32)
        for f, k in self.column.items():
            column_of[bins.base[f]:bins.base[f + 1]] = k
        self.laid = _laid(self.lengths, self.slot, column_of, self.slot, bins.zero[list(self.column)].astype(np.int32))

    def node(self, tree: Tree) -> np.ndarray:
        return tree.nodes(self.laid, self.column, len(self.label))

    def grown(self, trees: list[Tree]) -> np.ndarray:
        return self.margin + sum(t.weight * t.value[self.node(t)] for t in trees) if trees else self.margin


def _refreshed(blocks: DataFrame, trees: list[Tree], bins, parts: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [_Rows(batch, k, trees, bins.value).grown(trees).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margins, pa.binary())], NAMES)

    return written(blocks.mapInArrow(add, blocks.schema), "margins").coalesce(parts)


def _best(table: pa.Table, bins: Bins, low: int, high: int, n_open: int) -> pa.Table:
    """The best split of every open node among the features whose bins are low to high, from all partial sums."""
    count, total, whole = np.zeros(n_open * (high - low)), np.zeros(n_open * (high - low)), np.zeros((2, n_open))
    for k in range(table.num_rows):
        cell, n, s, t = (np.frombuffer(table[c][k].as_buffer(), kind) for c, kind in (("cells", np.int64), ("n", np.float64), ("s", np.float64), ("whole", np.float64)))
        count[cell] += n
        total[cell] += s
        whole += t.reshape(2, -1)
    first, end = np.searchsorted(bins.base, (low, high))
    starts, zero = bins.base[first:end] - low, bins.zero[first:end] - low
    out = []
    for k in range(n_open):
        n, s = whole[:, k]
        best = (-np.inf, 0, 0.0, 0.0)
        if high - low > end - first and n:
            left = []
            for cells, all_ in ((count, n), (total, s)):
                own = cells[k * (high - low):(k + 1) * (high - low)].copy()
                own[zero] = all_ - np.add.reduceat(own, starts)
                run = np.cumsum(own)
                left.append(run - np.repeat(run[starts] - own[starts], np.diff(np.append(starts, high - low))))
            n_left, s_left = np.rint(left[0]), left[1]
            n_right, s_right = n - n_left, s - s_left
            some = (n_left > 0) & (n_right > 0)
            some[np.append(starts[1:], high - low) - 1] = False
            gain = np.full(high - low, -np.inf)
            gain[some] = (s_left[some] ** 2 / n_left[some] + s_right[some] ** 2 / n_right[some] - s * s / n) / n
            top = gain.max()
            if top > LEAST:
                at = int(np.flatnonzero(gain >= top * (1 - SAME))[0])
                best = (float(gain[at]), at + low, float(n_left[at]), float(s_left[at]))
        out.append((k, *best, float(n), float(s)))
    return pa.table({c: pa.array([r[i] for r in out]) for i, c in enumerate(_SPLIT)})


_SPLIT = ["open", "gain", "bin", "n_left", "s_left", "n", "s"]


def _level(blocks: DataFrame, trees: list[Tree], tree: Tree, opened: list[int], cls: int, bins, first: bool, single: bool) -> list[tuple]:
    """Best split (gain, bin, rows and residuals that go left, all rows and residuals) of every open node."""
    known: Bins = bins.value
    size = len(known.thresholds)
    ends = known.base[np.unique(np.searchsorted(known.base, np.append(np.arange(RANGE_BINS, size, RANGE_BINS), size)))]
    ranges = list(zip([0, *ends[:-1].tolist()], ends.tolist()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Bins = bins.value
        count, total, whole = np.zeros((len(opened), size), np.int32), np.zeros((len(opened), size)), np.zeros((2, len(opened)))
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Rows(batch, row, [*trees, tree], own)
                sign = np.where(block.label == cls, 1.0, -1.0)
                rest = sign if first else 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * block.grown(trees), 700.0)))
                node = block.node(tree)
                for k, own_node in enumerate(opened):
                    here = node == own_node
                    if not here.any():
                        continue
                    whole[:, k] += here.sum(), rest[here].sum()
                    entry = np.repeat(here, block.lengths)
                    slot = block.slot[entry]
                    count[k] += np.bincount(slot, minlength=size).astype(np.int32)
                    total[k] += np.bincount(slot, np.repeat(rest[here], block.lengths[here]), size)
        for at, (low, high) in enumerate(ranges):
            n, s = count[:, low:high].ravel(), total[:, low:high].ravel()
            cell = np.flatnonzero(n)
            fields = (cell.astype(np.int64), n[cell].astype(np.float64), s[cell], whole)
            yield pa.RecordBatch.from_arrays([pa.array([at]), *(pa.array([np.ascontiguousarray(f).tobytes()], pa.binary()) for f in fields)], ["at", "cells", "n", "s", "whole"])

    def best(table: pa.Table) -> pa.Table:
        return _best(table, bins.value, *ranges[table["at"][0].as_py()], len(opened))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sums in partial(batches):
            yield from best(pa.Table.from_batches([sums])).to_batches()

    splits = "open long, gain double, bin long, n_left double, s_left double, n double, s double"
    if single:  # its sums are whole, a second pass through Python would only cost time
        found = blocks.mapInArrow(alone, splits).collect()
    else:
        found = blocks.mapInArrow(partial, "at long, cells binary, n binary, s binary, whole binary").groupBy("at").applyInArrow(best, splits).collect()
    out: list[tuple] = []
    for k in range(len(opened)):
        own = sorted((r for r in found if r["open"] == k), key=lambda r: r["bin"])
        top = max(r["gain"] for r in own)
        out.append(tuple(next(r for r in own if r["gain"] >= top - abs(top) * SAME))[1:] if top > LEAST else tuple(own[0])[1:])
    return out


def _grown(blocks: DataFrame, trees: list[Tree], cls: int, bins, depth: int, weight: float, first: bool, single: bool) -> Tree:
    """One more tree."""
    tree, opened, known = Tree.empty(depth, weight), [0], bins.value
    for level in range(depth):
        below: list[int] = []
        for node, (gain, at, n_left, s_left, n, s) in zip(opened, _level(blocks, trees, tree, opened, cls, bins, first, single)):
            tree.value[node] = s / n
            if not gain > LEAST:
                continue
            tree.feature[node], tree.cut[node] = int(np.searchsorted(known.base, at, side="right")) - 1, at
            tree.value[2 * node + 1], tree.value[2 * node + 2] = s_left / n_left, (s - s_left) / (n - n_left)
            below += [k for k, rows in ((2 * node + 1, n_left), (2 * node + 2, n - n_left)) if rows > 1]
        opened = below
        if not opened:
            break
    return tree


@dataclass(frozen=True)
class Boosted:
    """Trees of one class against the others, their cuts as thresholds of the features' values."""

    trees: list[Tree]

    def probabilities(self, pointers: np.ndarray, index: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
        column = _used(self.trees)
        column_of = np.full(size, -1, np.int32)
        column_of[list(column)] = np.arange(len(column))
        margins = []
        for at in range(0, len(pointers) - 1, 1024):  # bounds what is laid out at once
            own = pointers[at:at + 1025]
            a, b = own[0], own[-1]
            laid = _laid(np.diff(own), index[a:b], column_of, value[a:b], np.zeros(len(column)))
            margins.append(sum((t.weight * t.value[t.nodes(laid, column, len(laid))] for t in self.trees), np.zeros(len(laid))))
        return np.exp(-np.logaddexp(0.0, -2.0 * np.concatenate([*margins, np.zeros(0)])))


def boost(train: DataFrame, classes: list[int], size: int, label: str, trees: int, depth: int, step: float) -> dict[int, Boosted]:
    """Trees for each class against all others; bins and packed rows are shared."""
    seen = train.agg(F.count("*").alias("n"), F.count_if(F.col(label).isNull()).alias("bad")).first()
    if not seen["n"] or seen["bad"]:
        raise ValueError("no rows to fit on, or rows without a label")
    found = find_bins(train, seen["n"], size)
    bins = train.sparkSession.sparkContext.broadcast(found)
    packed = _packed(train, label, bins)
    parts = packed.rdd.getNumPartitions()
    members = {}
    for cls in classes:
        blocks, kept, fresh = packed, [], []
        for k in range(trees):
            if len(fresh) == REFRESH:
                blocks, fresh = _refreshed(blocks, fresh, bins, parts), []
            fresh.append(_grown(blocks, fresh, cls, bins, depth, step if k else 1.0, not k, parts == 1))
            kept.append(fresh[-1])
        for tree in kept:
            inner = tree.feature >= 0
            tree.cut[inner] = found.thresholds[tree.cut[inner].astype(np.int64)]
        members[cls] = Boosted(kept)
    bins.destroy()
    return members
