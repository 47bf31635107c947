"""Hashed sparse text features, their numpy matrix form and a small L-BFGS, shared by the two classifiers."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lexsieve.llm import rolling


@dataclass(frozen=True)
class HashedText:
    """Feature map of hashed byte 3-grams (style), lower-case words (vocabulary), their beginnings of the given
    numbers of bytes (inflected and disguised words) and word echoes (repetition)."""

    bits: int = 16
    grams: bool = True
    words: bool = False
    stems: tuple[int, ...] = ()
    echoes: bool = False
    presence: bool = False

    @property
    def width(self) -> int:
        return (int(self.grams) + int(self.words) + len(self.stems) + int(self.echoes)) << self.bits

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(document, feature index) of every occurrence, one pair of arrays for each kind, documents ascending."""
        found, base, shift = [], 0, np.uint64(64 - self.bits)
        if self.grams:
            if len(data) >= 3:
                low = rolling.LOWER[data].astype(np.uint64)
                code = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                at = np.flatnonzero(doc[:-2] == doc[2:])
                index = (rolling.mix(code[at]) >> shift).astype(np.int64)
                found.append((doc[at], index + base))
            base += 1 << self.bits
        if self.words:
            cut = rolling.cut_words(rolling.LOWER[data], offsets, rolling.LOWER_ALNUM)
            found.append((cut.doc, (cut.hashes >> shift).astype(np.int64) + base))
            base += 1 << self.bits
            for size in self.stems:
                long = np.flatnonzero(cut.ends - cut.starts > size)
                stem = rolling.byte_hashes(cut.data, cut.starts[long], cut.starts[long] + size)
                found.append((cut.doc[long], (stem >> shift).astype(np.int64) + base))
                base += 1 << self.bits
        if self.echoes:
            cut = rolling.cut_words(data, offsets, rolling.GRAPHIC)
            if len(cut.doc):
                echo = np.zeros(len(cut.doc), np.int64)
                echo[1:] = (cut.hashes[1:] == cut.hashes[:-1]) & (cut.doc[1:] == cut.doc[:-1])
                found.append((cut.doc, echo + base))
        return found

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows (bounds, index, value) of a slice of documents."""
        n, width = len(offsets) - 1, self.width
        docs, cells, values = [], [], []
        for doc, index in self.occurrences(data, offsets):
            key, count = np.unique(doc * width + index, return_counts=True)
            row = key // width
            if self.presence:
                value = np.ones(len(key))
            else:
                total = np.bincount(doc, minlength=n)
                value = count / np.maximum(total[row], 1)
            docs.append(row), cells.append(key % width), values.append(value)
        if not docs:
            return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, cell, value = map(np.concatenate, (docs, cells, values))
        order = np.argsort(row, kind="stable")
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=n), out=bounds[1:])
        return bounds, cell[order], value[order]

    def scores(self, weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Weighted feature sum of each document, straight from the occurrences."""
        n, out = len(offsets) - 1, np.zeros(len(offsets) - 1)
        for doc, index in self.occurrences(data, offsets):
            if self.presence:
                key = np.unique(doc * self.width + index)
                out += np.bincount(key // self.width, weights[key % self.width], minlength=n)
            else:
                out += np.bincount(doc, weights[index], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)
        return out


@dataclass
class Sparse:
    """Row-compressed matrix with the two products that a linear fit needs."""

    bounds: np.ndarray
    index: np.ndarray
    value: np.ndarray
    width: int

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def _blocks(self) -> Iterator[tuple[int, int, slice]]:
        """Row ranges of about a million entries, so that products need little room beside the matrix."""
        edges = np.unique(np.append(np.searchsorted(self.bounds, np.arange(0, self.bounds[-1], 1 << 20), side="right") - 1, len(self)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(a), int(b), slice(int(self.bounds[a]), int(self.bounds[b]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for a, b, part in self._blocks():
            out[a:b] = np.bincount(self.row[part] - a, weights[self.index[part]] * self.value[part], minlength=b - a)
        return out

    def transposed_times(self, residual: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for _, _, part in self._blocks():
            out += np.bincount(self.index[part], residual[self.row[part]] * self.value[part], minlength=self.width)
        return out

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = np.diff(self.bounds)[rows]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.bounds[:-1][rows] - bounds[:-1], sizes) + np.arange(bounds[-1])
        return Sparse(bounds, self.index[at], self.value[at], self.width)


def sparse_batch(features: HashedText, batch: pa.RecordBatch, text: str) -> tuple[pa.Array, pa.Array]:
    """Feature rows of a batch as two binary columns (int32 index, float32 value)."""
    index, value = [], []
    for _, data, offsets in rolling.slices(batch, text):
        bounds, cell, val = features.rows(data, offsets)
        cell, val = cell.astype(np.int32), val.astype(np.float32)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            index.append(cell[a:b].tobytes()), value.append(val[a:b].tobytes())
    return pa.array(index, pa.binary()), pa.array(value, pa.binary())


def _cells(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The numbers of each row of a binary column, as views of its buffers."""
    rows = []
    for chunk in column.chunks:
        wide = pa.types.is_large_binary(chunk.type)
        at = np.frombuffer(chunk.buffers()[1], np.int64 if wide else np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        data = chunk.buffers()[2]
        rows += [np.frombuffer(data, kind, (b - a) // kind().itemsize, a) if b > a else np.zeros(0, kind) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return rows


def sparse_of(index: pa.ChunkedArray, value: pa.ChunkedArray, width: int, order: np.ndarray | None = None) -> Sparse:
    """The matrix of collected `sparse_batch` columns, its rows in `order`; no row is copied but into the matrix."""
    def whole(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, list[int]]:
        rows = _cells(column, kind)
        rows = rows if order is None else [rows[i] for i in order]
        return np.concatenate([*rows, np.zeros(0, kind)]), [len(r) for r in rows]

    cells, sizes = whole(index, np.int32)
    return Sparse(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), cells, whole(value, np.float32)[0], width)


def release_unused() -> None:
    """Give back what Arrow holds of tables that are gone; the driver keeps only the matrix and the weights."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 80,
             memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with backtracking for a smooth function that returns (value, gradient)."""
    x, (f, g) = start, loss(start)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, y, rho in reversed(moves):
            a = rho * (s @ d)
            d = d - a * y
            kept.append(a)
        if moves:
            s, y, rho = moves[-1]
            d = d / (rho * (y @ y))
        for (s, y, rho), a in zip(moves, reversed(kept), strict=True):
            d = d + (a - rho * (y @ d)) * s
        slope, step = g @ d, 1.0 if moves else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        if slope >= 0:
            break
        for _ in range(30):
            new = x + step * d
            f_new, g_new = loss(new)
            if f_new <= f + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            moves = [*moves[1 - memory:], (s, y, 1.0 / (s @ y))]
        done = abs(f - f_new) <= tolerance * max(abs(f), 1.0)
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))
