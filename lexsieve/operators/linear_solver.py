"""Many penalised linear problems over one table of feature vectors, solved together.

A problem is a class (its rows count as +1, all others as -1) and, optionally, a fold of rows that it leaves out. All
problems share every scan: tasks hold the weights of all of them as one matrix and return sums by ranges of features, which are
added in a shuffle, so no single task adds up whole gradients. The steps are Newton's. Where the second derivatives of all
problems fit the bound of the weights (some hundred features, as averaged embeddings have), the tasks return them; beyond, the
steps come from conjugate gradients: a scan returns one product with the second derivatives, at half precision (the steps are
inexact anyway, gradients are not). The gradients are scaled by the inverse of an estimate of the second derivatives, made of some
rows, drawn by their weight in them, and of the diagonal. It only shortens the way: products, gradients and losses come from all
rows. The squared hinge is solved for rising c, each time from the last solution. A problem that is done leaves the matrix.

Rows are packed once into blocks of compressed sparse rows, written to the shared folder. The objective is

    1/2 |w|^2 + c * sum of losses,

with the intercept among the penalised weights or outside, losses max(0, 1 - y m)^2, log(1 + exp(-y m)) or, over the classes of
all problems as one, minus the logarithm of the softmax of their margins.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.plans.scale import written

#: Entries of one block and features of one range of the gradient.
BLOCK_ENTRIES, RANGE = 1 << 20, 4096
#: Bytes of packed rows below which parts are joined, and those of a part that is one of more than there are cores.
PART_BYTES, WIDE_PART_BYTES = 16 << 20, 128 << 20
#: Bytes of one weight matrix; more problems than fit are solved in groups.
WEIGHT_BYTES = 64 << 20
#: Products of one step at most.
PRODUCTS = 400
#: Bytes of partial sums of a scan that the driver adds up itself; more are added in a shuffle.
GATHER_BYTES = 64 << 20
#: Rows of the estimate at most, their squares over all problems, their entries; the least share of the diagonal that it keeps.
GUIDES, GUIDE_SQUARES, GUIDE_ENTRIES, GUIDE_FLOOR = 2048, 1 << 23, 1 << 22, 0.1
#: Entries of a feature among these rows beyond which it is multiplied densely, and features laid out at once.
DENSE_FROM, DENSE_STEP = 12, 4096
#: Lengths of a step at which losses are added up: 0, then 1/1024 to 8.
LENGTHS = np.concatenate(([0.0], 2.0 ** (np.arange(-20, 7) / 2)))

Loss = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def squared_hinge(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss and its derivatives at the signed margins z = y * m."""
    short = np.maximum(0.0, 1.0 - z)
    return short * short, -2.0 * short, 2.0 * (short > 0)


def logistic(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log(1 + exp(-z)) and its derivatives, without overflow."""
    small = np.exp(-np.abs(z))
    return np.log1p(small) + np.maximum(-z, 0.0), -np.where(z > 0, small, 1.0) / (1.0 + small), small / (1.0 + small) ** 2


def softmax(m: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Losses by column (their sum counts), their derivatives and the probabilities, from the margins of all classes."""
    m = m - m.max(axis=1, keepdims=True)
    p = np.exp(m)
    mass = p.sum(axis=1, keepdims=True)
    p /= mass
    return np.where(hit, np.log(mass) - m, 0.0), p - hit, p


@dataclass(frozen=True)
class Solution:
    """Weights (features + 1 for the intercept, problems), and how far each problem was solved."""

    weights: np.ndarray
    largest_gradient: np.ndarray
    scans: int
    converged: np.ndarray

    def margins(self, features: str = "features") -> Column:
        """Array of the margins of all problems for each row."""
        weights = self.weights

        @F.arrow_udf("array<double>")
        def score(vectors: pa.Array) -> pa.Array:
            pointers, index, value = sparse_rows(vectors)
            found = row_margins(pointers, index, value, weights)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * weights.shape[1], pa.int32()), pa.array(found.ravel()))

        return score(features)


def sparse_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, indices and values of ML vectors as they arrive through Arrow, sparse or dense."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = vectors.field("values")
    if vectors.null_count or values.null_count:
        raise ValueError("a row has no feature vector")
    flat, offsets = values.values.to_numpy(), values.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = flat[offsets[0]:offsets[-1]]
    dense = vectors.field("type").to_numpy() == 1
    index = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if not dense.all():
        index[np.repeat(~dense, sizes)] = vectors.field("indices").flatten().to_numpy()
    return np.concatenate(([0], np.cumsum(sizes))), index.astype(np.int64), flat


def row_margins(pointers: np.ndarray, index: np.ndarray, value: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.tile(weights[-1], (len(pointers) - 1, 1))
    full = np.flatnonzero(np.diff(pointers))
    step = 1 << 22  # bounds the products held at once
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(pointers[full], pointers[full[at]] + step, side="right")) - 1)
        to = len(full) if pointers[-1] - pointers[full[at]] <= step else to
        a, b = pointers[full[at]], pointers[full[to - 1] + 1]
        for k in range(weights.shape[1]):
            out[full[at:to], k] += np.add.reduceat(weights[index[a:b], k] * value[a:b], pointers[full[at:to]] - a)
        at = to
    return out


def packed_rows(rows: DataFrame, label: str, fold: str | None, features: str = "features") -> DataFrame:
    """Blocks of rows: pointers, indices, values, class codes and folds."""
    chosen = rows.select(F.col(label).cast("long").alias("label"), (F.col(fold) if fold else F.lit(-1)).cast("long").alias("fold"), F.col(features).alias("features"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pointers, index, value = sparse_rows(batch.column(2))
            label_, fold_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(pointers, pointers[at] + BLOCK_ENTRIES, side="right")) - 1)
                a, b = pointers[at], pointers[to]
                fields = (pointers[at:to + 1] - a, index[a:b].astype(np.int32), value[a:b], label_[at:to], fold_[at:to])
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(f).tobytes()], pa.binary()) for f in fields], NAMES)
                at = to

    blocks = written(chosen.mapInArrow(pack, ", ".join(f"{n} binary" for n in NAMES)), "instances")
    size = blocks.agg(F.sum(sum((F.octet_length(n) for n in NAMES), F.lit(0).cast("long")))).first()[0] or 0
    # every scan costs each part a task and its own sums, so parts are few: one a core, unless they were too large
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, -(-size // PART_BYTES)), -(-size // WIDE_PART_BYTES))
    return blocks.coalesce(parts) if parts < blocks.rdd.getNumPartitions() else blocks


NAMES = ["pointers", "index", "value", "label", "fold"]
_KINDS = [np.int64, np.int32, np.float64, np.int64, np.int64]


def _add_curvature(total: np.ndarray, pointers: np.ndarray, index: np.ndarray, value: np.ndarray, bend: np.ndarray) -> None:
    """Add the second derivatives of all problems, from the rows laid out densely a few thousand at a time."""
    size = total.shape[1]
    step = max(1, (1 << 21) // size)
    for at in range(0, len(bend), step):
        to = min(at + step, len(bend))
        a, b = pointers[at], pointers[to]
        dense = np.zeros((to - at, size))
        dense[np.repeat(np.arange(to - at), np.diff(pointers[at:to + 1])), index[a:b]] = value[a:b]
        dense[:, -1] = 1.0
        for k in range(len(total)):
            total[k] += dense.T @ (dense * bend[at:to, k, None])


def _losses(loss: Loss, label: np.ndarray, classes: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
    """Losses, first and second derivatives by row and column, and the product of the second derivatives with margins."""
    hit = label[:, None] == classes
    if loss is softmax:
        here, slope, p = softmax(m, hit)
        return here, slope, p * (1.0 - p), lambda q: p * (q - (p * q).sum(axis=1, keepdims=True))
    sign = np.where(hit, 1.0, -1.0)
    here, slope, bend = loss(sign * m)
    return here, sign * slope, bend, lambda q: bend * q


def _scan(blocks: DataFrame, weights: np.ndarray, way: np.ndarray | None, classes: np.ndarray, skipped: np.ndarray, loss: Loss,
          kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One scan of all rows: sums of each problem, sums by feature (features + 1, columns), second derivatives.

    ``kind`` says what is added up at the weights: ``curved`` losses, gradients and second derivatives; ``point`` losses,
    gradients and the diagonal of the second derivatives; ``product`` those derivatives times ``way``; ``line`` losses
    and slopes at all LENGTHS along ``way``.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((np.asfortranarray(weights), way if way is None else np.asfortranarray(way), classes, skipped))  # at most 2 x WEIGHT_BYTES
    k, size = weights.shape[1], len(weights)
    columns = {"curved": k, "point": 2 * k, "product": k, "line": 0}[kind]
    exact = np.float32 if kind == "product" else np.float64
    direct = blocks.rdd.getNumPartitions() * columns * size * np.dtype(exact).itemsize <= GATHER_BYTES and kind != "curved"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, along, cls, skip = shared.value
        total = np.zeros((2 * len(LENGTHS), k) if kind == "line" else (1, k))
        sums = np.zeros((columns, size))
        curvature = np.zeros((k if kind == "curved" else 0, size, size))

        def add(row: int, entries: np.ndarray, by_row: np.ndarray) -> None:
            sums[row, -1] += by_row.sum()
            sums[row, :-1] += np.bincount(index, entries * np.repeat(by_row, lengths), size - 1)

        for batch in batches:
            for row in range(batch.num_rows):
                pointers, index, value, label, fold = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate(_KINDS))
                lengths = np.diff(pointers)
                margin = row_margins(pointers, index, value, own)
                used = fold[:, None] != skip
                if kind == "line":
                    to = row_margins(pointers, index, value, along)
                    for i, t in enumerate(LENGTHS):
                        here, slope, _, _ = _losses(loss, label, cls, margin + t * to)
                        total[2 * i] += (here * used).sum(axis=0)
                        total[2 * i + 1] += (slope * to * used).sum(axis=0)
                    continue
                here, slope, bend, curve = _losses(loss, label, cls, margin)
                if kind == "product":
                    slope = curve(row_margins(pointers, index, value, along))
                total[0] += (here * used).sum(axis=0)
                for j in range(k):
                    add(j, value, slope[:, j] * used[:, j])
                if kind == "point":
                    for j in range(k):
                        add(k + j, value * value, bend[:, j] * used[:, j])
                if kind == "curved":
                    _add_curvature(curvature, pointers, index, value, bend * used)
        for j, part in enumerate(curvature):
            yield pa.RecordBatch.from_arrays([pa.array([-2 - j]), pa.array([part.tobytes()], pa.binary())], ["at", "sums"])
        for at in range(0, size if columns else 0, RANGE):
            if (part := sums[:, at:at + RANGE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.ascontiguousarray(part, exact).tobytes()], pa.binary())], ["at", "sums"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([total.tobytes()], pa.binary())], ["at", "sums"])

    def add_up(table: pa.Table) -> pa.Table:
        own = exact if table["at"][0].as_py() >= 0 else np.float64
        whole = sum(np.frombuffer(x.as_buffer(), own).astype(np.float64) for x in table["sums"].combine_chunks()).astype(own)
        return pa.table({"at": table["at"][:1], "sums": pa.array([whole.tobytes()], pa.binary())})

    total, sums = np.zeros((2 * len(LENGTHS) if kind == "line" else 1, k)), np.zeros((size, columns))
    curvature = np.zeros((k if kind == "curved" else 0, size, size))
    found = blocks.mapInArrow(partial, "at long, sums binary")
    if not direct:
        found = found.groupBy("at").applyInArrow(add_up, "at long, sums binary")
    for row in found.toLocalIterator() if not direct and size * columns > WEIGHT_BYTES >> 3 else found.collect():
        if row["at"] < -1:
            curvature[-2 - row["at"]] += np.frombuffer(row["sums"]).reshape(size, -1)
        elif row["at"] < 0:
            total += np.frombuffer(row["sums"]).reshape(total.shape)
        else:
            sums[row["at"]:row["at"] + RANGE] += np.frombuffer(row["sums"], exact).reshape(columns, -1).T
    shared.destroy()
    return total, sums, curvature


class _Guide:
    """Inverse of an estimate of the second derivatives of each problem: weighted rows and a diagonal for what they leave."""

    def __init__(self, spark: SparkSession, lengths: np.ndarray, index: np.ndarray, value: np.ndarray, weight: np.ndarray,
                 scale: np.ndarray, penalised: np.ndarray) -> None:
        self.index, self.value, self.row, self.root = index, value, np.repeat(np.arange(len(lengths)), lengths), np.sqrt(weight)
        held = np.stack([np.bincount(index, value * value * w[self.row], len(scale)) for w in weight.T], axis=1)
        held[-1] = weight.sum(axis=0)
        self.diagonal = np.maximum(scale - held, np.maximum(penalised[:, None], GUIDE_FLOOR * scale))
        self.inverse = _inverses(spark, self.row, index, value, self.root, self.diagonal)

    def __call__(self, r: np.ndarray, own: np.ndarray) -> np.ndarray:
        out, n = np.empty_like(r), len(self.root)
        for j, k in enumerate(own):
            z = r[:, j] / self.diagonal[:, k]
            inner = (np.bincount(self.row, z[self.index] * self.value, n) + z[-1]) * self.root[:, k]
            inner = (self.inverse[k] @ inner) * self.root[:, k]
            back = np.bincount(self.index, self.value * inner[self.row], len(z))
            back[-1] = inner.sum()
            out[:, j] = z - back / self.diagonal[:, k]
        return out


def _inverses(spark: SparkSession, row: np.ndarray, index: np.ndarray, value: np.ndarray, root: np.ndarray, diagonal: np.ndarray) -> list[np.ndarray]:
    """Inverse of the unit matrix and the scaled products of the rows, for each problem; every problem is a task."""
    counts = np.bincount(index, minlength=len(diagonal))
    place = np.empty(len(diagonal), np.int64)  # frequent features first, each one's entries side by side
    place[np.argsort(-counts, kind="stable")] = np.arange(len(diagonal))
    order = np.argsort(place[index], kind="stable")
    dense = int((counts > DENSE_FROM).sum())
    shared = spark.sparkContext.broadcast((row[order].astype(np.int32), index[order].astype(np.int32), place, value[order], root, diagonal))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_, index_, place_, value_, root_, diagonal_ = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                gram = _row_products(row_, place_[index_], value_ / np.sqrt(diagonal_[index_, k]), dense, len(root_))
                gram += 1.0 / diagonal_[-1, k]
                gram *= root_[:, k, None] * root_[:, k]
                gram[np.diag_indices(len(gram))] += 1.0
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.linalg.inv(gram).tobytes()], pa.binary())], ["id", "inverse"])

    n, problems = root.shape
    found = spark.range(0, problems, 1, problems).mapInArrow(invert, "id long, inverse binary").collect()  # GUIDE_SQUARES
    shared.destroy()
    return [np.frombuffer(r["inverse"]).reshape(n, n) for r in sorted(found, key=lambda r: r["id"])]


def _row_products(row: np.ndarray, feature: np.ndarray, value: np.ndarray, dense: int, n: int) -> np.ndarray:
    """Products of all rows with each other, from entries in the order of their features, the first ``dense`` of them frequent."""
    out = np.zeros((n, n))
    for at in range(0, dense, DENSE_STEP):
        a, b = np.searchsorted(feature, [at, min(at + DENSE_STEP, dense)])
        laid = np.zeros((n, min(DENSE_STEP, dense - at)), np.float32)
        laid[row[a:b], feature[a:b] - at] = value[a:b]
        out += laid @ laid.T
    a = int(np.searchsorted(feature, dense))
    row, feature, value = row[a:], feature[a:], value[a:]
    for apart in range(min(DENSE_FROM, len(row))):
        first = np.flatnonzero(feature[:len(feature) - apart] == feature[apart:])
        other = first + apart
        pairs = np.bincount(row[first].astype(np.int64) * n + row[other], value[first] * value[other], n * n).reshape(n, n)
        out += pairs if apart == 0 else pairs + pairs.T
    return out


def _guide(blocks: DataFrame, weights: np.ndarray, scale: np.ndarray, penalised: np.ndarray, classes: np.ndarray, skipped: np.ndarray,
           loss: Loss, c: float) -> _Guide:
    """Rows drawn with chances in proportion to their leverage under the diagonal, heavy ones always, weighted by the inverse."""
    k = weights.shape[1]
    most, room = min(GUIDES, int((GUIDE_SQUARES / k) ** 0.5)), GUIDE_ENTRIES // blocks.rdd.getNumPartitions()
    mass = np.maximum((1.0 - penalised[:, None] / scale).sum(axis=0), 1e-12)  # the leverages of all rows together
    shared = blocks.sparkSession.sparkContext.broadcast((np.asfortranarray(weights), np.asfortranarray(1.0 / scale), classes, skipped))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, inverse, cls, skip = shared.value
        left = room
        for batch in batches:
            for at in range(batch.num_rows):
                pointers, index, value, label, fold = (np.frombuffer(batch.column(i)[at].as_buffer(), t) for i, t in enumerate(_KINDS))
                bend = c * _losses(loss, label, cls, row_margins(pointers, index, value, own))[2] * (fold[:, None] != skip)
                chance = most * (bend * row_margins(pointers, index, value * value, inverse) / mass).mean(axis=1)
                drawn = np.flatnonzero(np.random.default_rng(zlib.crc32(value.tobytes())).random(len(chance)) < chance)
                drawn = drawn[np.argsort(-chance[drawn], kind="stable")]
                lengths = np.diff(pointers)
                drawn = drawn[np.cumsum(lengths[drawn]) <= left]
                left -= int(lengths[drawn].sum())
                some = np.concatenate([np.zeros(0, np.int64), *(np.arange(pointers[r], pointers[r + 1]) for r in drawn)])
                fields = (lengths[drawn], index[some], value[some], bend[drawn] / np.minimum(1.0, chance[drawn])[:, None])
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(f).tobytes()], pa.binary()) for f in fields], names)

    names = ["lengths", "index", "value", "weight"]
    found = blocks.mapInArrow(pick, ", ".join(f"{n} binary" for n in names)).collect()  # at most GUIDE_ENTRIES
    shared.destroy()
    lengths, index, value, weight = (np.concatenate([np.zeros(0, t), *(np.frombuffer(r[n], t) for r in found)])
                                     for n, t in zip(names, (np.int64, np.int32, np.float64, np.float64)))
    return _Guide(blocks.sparkSession, lengths, index.astype(np.int64), value, weight.reshape(-1, k), scale, penalised)


class _Descent:
    """State of one problem whose second derivatives are known."""

    def __init__(self, size: int) -> None:
        self.at, self.value, self.gradient = np.zeros(size), np.inf, None
        self.way: np.ndarray | None = None
        self.step, self.first, self.stuck = 1.0, 0.0, False

    @property
    def trial(self) -> np.ndarray:
        return self.at if self.way is None else self.at + self.step * self.way

    def largest(self) -> float:
        return float(np.abs(self.gradient).max())

    def saw(self, value: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
        """Take the trial point if it is low enough, else try nearer."""
        if self.way is not None:
            slope = float(self.gradient @ self.way)
            if value > self.value + 1e-4 * self.step * slope + 1e-13 * abs(self.value):
                # minimum of the parabola through both values and the slope, within bounds
                bend = value - self.value - self.step * slope
                self.step *= min(0.5, max(0.1, -slope * self.step / (2 * bend)))
                self.stuck = self.step < 1e-12
                return
            self.at = self.trial
        else:
            self.first = float(np.abs(gradient).max())
        self.value, self.gradient = value, gradient
        self.way, self.step = -np.linalg.lstsq(curvature, gradient)[0], 1.0


def _solve_narrow(blocks: DataFrame, size: int, classes: np.ndarray, skipped: np.ndarray, loss: Loss, c: float,
                  penalised: np.ndarray, tol: float, max_scans: int) -> Solution:
    """Newton steps from the second derivatives themselves."""
    problems = [_Descent(size) for _ in classes]
    done = np.zeros(len(problems), bool)
    scans = 0
    while not done.all() and scans < max_scans:
        open_ = np.flatnonzero(~done)
        trial = np.stack([problems[k].trial for k in open_], axis=1)
        total, gradient, curvature = _scan(blocks, trial, None, classes[open_], skipped[open_], loss, "curved")
        scans += 1
        for j, k in enumerate(open_):
            w = trial[:, j] * penalised
            problems[k].saw(0.5 * float(w @ w) + c * total[0, j], w + c * gradient[:, j], c * curvature[j] + np.diag(penalised))
            done[k] = problems[k].stuck or problems[k].largest() <= max(tol, 1e-10 * problems[k].first)
    largest = np.array([p.largest() for p in problems])
    limits = np.array([max(tol, 1e-10 * p.first) for p in problems])
    return Solution(np.stack([p.at for p in problems], axis=1), largest, scans, largest <= limits)


def _best_lengths(values: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """The length of the step of each problem: 1 where the slope is gone there, else where it crosses zero."""
    whole, out = int(np.flatnonzero(LENGTHS == 1.0)[0]), np.ones(values.shape[1])
    for j, (f, d) in enumerate(zip(values.T, slopes.T)):
        if abs(d[whole]) > 0.1 * abs(d[0]) or f[whole] > f[0]:
            up = np.flatnonzero(d[1:] > 0)
            i = int(up[0]) + 1 if len(up) else len(d) - 1
            between = -d[i - 1] / (d[i] - d[i - 1]) if d[i] > 0 >= d[i - 1] else 1.0
            out[j] = LENGTHS[i - 1] + between * (LENGTHS[i] - LENGTHS[i - 1])
    return out


def _solve_wide(blocks: DataFrame, size: int, classes: np.ndarray, skipped: np.ndarray, loss: Loss, c: float,
                penalised: np.ndarray, tol: float, max_scans: int) -> Solution:
    """Newton steps from conjugate gradients, all problems in step; the classes of the softmax are one problem."""
    fixed_, scans = penalised[:, None], 0

    def joined(by_column: np.ndarray, add: Callable = np.sum) -> np.ndarray:
        return np.full_like(by_column, add(by_column)) if loss is softmax else by_column

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return joined(np.einsum("ij,ij->j", a, b))

    def scan(kind: str, some: np.ndarray, at: np.ndarray, way: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        nonlocal scans
        scans += 1
        return _scan(blocks, at, way, classes[some], skipped[some], loss, kind)[:2]

    def point(some: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Losses, their gradients and the diagonals of their second derivatives."""
        total, sums = scan("point", some, at)
        return [total[0], sums[:, :len(some)], sums[:, len(some):]]

    def objective(at: np.ndarray, seen: list[np.ndarray], c: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total, gradient, bend = seen
        return joined(0.5 * (fixed_ * at * at).sum(axis=0) + c * total), fixed_ * at + c * gradient, np.maximum(fixed_ + c * bend, 1e-12)

    def steps(some: np.ndarray, at: np.ndarray, gradient: np.ndarray, scale: np.ndarray, share: np.ndarray, c: float) -> np.ndarray:
        """The way of each problem, its scaled residual at most ``share`` of the first one."""
        nonlocal scans
        scans += 1
        guide = _guide(blocks, at, scale, penalised, classes[some], skipped[some], loss, c)
        out, r, own = np.zeros_like(at), -gradient, np.arange(len(some))
        p = guide(r, own)
        left = dot(r, p)
        goal = share * share * left
        for _ in range(PRODUCTS):
            product = fixed_ * p + c * scan("product", some[own], at[:, own], p)[1]
            bend = dot(p, product)
            length = np.divide(left, bend, out=np.zeros_like(left), where=bend > 0)
            out[:, own] += length * p
            r -= length * product
            z = guide(r, own)
            now = dot(r, z)
            more = (now > goal[own]) & (bend > 0)
            if not more.any() or scans >= max_scans:
                break
            p = z + np.divide(now, left, out=np.zeros_like(now), where=left > 0) * p
            p, r, left, own = p[:, more], r[:, more], now[more], own[more]
        return out

    everything = np.arange(len(classes))
    at = np.zeros((size, len(classes)))
    seen = point(everything, at)
    limits = np.maximum(tol, 1e-10 * joined(np.abs(objective(at, seen, c)[1]).max(axis=0), np.max))
    rising = c * 10.0 ** -np.arange(max(0, int(np.ceil(np.log10(max(1.0, c * seen[2].max()))))) if loss is squared_hinge else 0, -1, -1.0)
    for own_c in rising.tolist():
        value, gradient, scale = objective(at, seen, own_c)
        largest, first = joined(np.abs(gradient).max(axis=0), np.max), np.sqrt(dot(gradient, gradient))
        ends, stuck = limits if own_c == rising[-1] else np.maximum(limits, 0.1 * largest), np.zeros(len(classes), bool)
        while scans < max_scans and len(some := np.flatnonzero((largest > ends) & ~stuck)):
            norm = np.sqrt(dot(gradient, gradient))[some]
            way = steps(some, at[:, some], gradient[:, some], scale[:, some], np.minimum(0.1, np.sqrt(norm / first[some])), own_c)
            found = scan("line", some, at[:, some], way)[0]
            both, square = dot(fixed_ * at[:, some], way), dot(fixed_ * way, way)
            values = own_c * np.array([joined(v) for v in found[0::2]]) + LENGTHS[:, None] * both + 0.5 * LENGTHS[:, None] ** 2 * square
            slopes = own_c * np.array([joined(v) for v in found[1::2]]) + both + LENGTHS[:, None] * square
            trial = at[:, some] + _best_lengths(values, slopes) * way
            there = point(some, trial)
            now = objective(trial, there, own_c)
            lower = (now[0] < value[some]) | (np.sqrt(dot(now[1], now[1])) < norm)
            stuck[some[~lower]] = True
            taken = some[lower]
            at[:, taken] = trial[:, lower]
            for old, new in zip((*seen, value, gradient, scale), (*there, *now)):
                old[..., taken] = new[..., lower]
            largest = joined(np.abs(gradient).max(axis=0), np.max)
    return Solution(at, largest, scans, largest <= limits)


def solve_linear(rows: DataFrame, n_features: int, problems: list[tuple[int, int | None]], *, label: str = "y", fold: str | None = None,
                 loss: Loss = squared_hinge, c: float = 1.0, penalise_intercept: bool = True, tol: float = 1e-4,
                 max_scans: int = 1000) -> Solution:
    """Solve every (class, left-out fold) over (label, fold, features) until its largest gradient component is at most ``tol``.

    Rows without a label belong to no class and count as -1 in every problem; an empty table gives zero weights. The classes of
    the softmax are solved as one problem.
    """
    blocks = packed_rows(rows, label, fold)
    size = n_features + 1
    penalised = np.ones(size)
    penalised[-1] = float(penalise_intercept)
    together = len(problems) if loss is softmax else max(1, WEIGHT_BYTES // (8 * size))
    parts = []
    for at in range(0, len(problems), together):
        some = problems[at:at + together]
        narrow = loss is not softmax and 8 * len(some) * size * size <= WEIGHT_BYTES
        solve = _solve_narrow if narrow else _solve_wide
        parts.append(solve(blocks, size, np.array([p[0] for p in some]), np.array([-2 if p[1] is None else p[1] for p in some]),
                           loss, c, penalised, tol, max_scans))
    return Solution(np.concatenate([p.weights for p in parts], axis=1), np.concatenate([p.largest_gradient for p in parts]),
                    sum(p.scans for p in parts), np.concatenate([p.converged for p in parts]))
