"""Codes of vectors by integer k-means of their parts, each round run on metric trees.

Vectors are cut into equal consecutive parts with a codebook each. Every block of vectors gets one metric tree per part,
once, by the anchors hierarchy:

* about sqrt(n) anchors are placed, each new one at the point farthest from its owner in the widest ball, taking over
  what lies nearer to it; points that the triangle inequality keeps with their owner are not looked at;
* balls are merged upwards, always the two whose joint ball is smallest, and divided downwards by anchors of their own
  (middle-out); every ball caches the sums and the number of its points.

A round sends the codebooks through the trees. A ball inherits the candidate entries of its parent and drops those that
are farther from its centre than the nearest one by more than the ball's diameter. A ball with one candidate left is
wholly owned: its cached sums go to the entry and nothing below is visited. Points of leaves meet their remaining
candidates only. Trees lie in the shared folder; a round is one scan that returns sums for each entry, whatever the size.

Edge cases: rows with a null vector or with null or non-finite components are dropped; an empty table gives no rows.
Shorter vectors count as followed by zeros. Repeated rows and rows that share an id (or have none) are vectors of their
own; the first entries are taken by id, nulls last, then by vector. With fewer vectors than entries the codebooks have as
many entries as there are vectors. Equal distances go to the lower index. Integers saturate where squared distances
would leave the range of long (at +-2^27 for 64 components). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm.vectors import integers, matrix, usable, widest
from lexsieve.plans.scale import lookup, spread, written

BLOCK, LEAF = 4096, 48
RESULT = "vec_id long, code string, error long, label string"


def place_anchors(points: np.ndarray, k: int) -> list[np.ndarray]:
    """Points (as indices) owned by each of up to k anchors; fewer if the points have fewer distinct values."""
    away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    order = np.argsort(-away, kind="stable")
    anchors, owned, far = [points[0]], [order], [away[order]]  # owned points by falling distance
    while len(anchors) < k:
        widest_ = max(range(len(anchors)), key=lambda i: far[i][0])
        if far[widest_][0] == 0:
            break
        new = points[owned[widest_][0]]
        taken, taken_far = [], []
        for i, anchor in enumerate(anchors):
            # a point nearer to its anchor than half the way to the new one stays
            n = int(np.searchsorted(-far[i], -0.5 * np.sqrt(((anchor - new) ** 2).sum()), side="left"))
            if not n:
                continue
            d = np.sqrt(((points[owned[i][:n]] - new) ** 2).sum(axis=1))
            moves = d < far[i][:n]
            if moves.any():
                taken.append(owned[i][:n][moves])
                taken_far.append(d[moves])
                stays = np.concatenate([~moves, np.ones(len(owned[i]) - n, bool)])
                owned[i], far[i] = owned[i][stays], far[i][stays]
        mine, d = np.concatenate(taken), np.concatenate(taken_far)
        order = np.argsort(-d, kind="stable")
        anchors.append(new)
        owned.append(mine[order])
        far.append(d[order])
    return owned


def _merged(groups: list, points: np.ndarray) -> list:
    """A binary tree (nested pairs) over the groups, by merging the two with the smallest joint ball first."""
    sizes = np.array([len(g) for g in groups], float)
    centres = np.stack([points[g].mean(axis=0) for g in groups])
    radii = np.array([np.sqrt(((points[g] - c) ** 2).sum(axis=1)).max() for g, c in zip(groups, centres)])
    trees: list = [_divided(g, points) for g in groups]
    n = len(groups)
    open_ = np.ones(n, bool)

    def joint(i: int) -> np.ndarray:
        weight = (sizes / (sizes + sizes[i]))[:, None]
        middle = centres * weight + centres[i] * (1 - weight)
        own = np.sqrt(((middle - centres) ** 2).sum(axis=1)) + radii
        other = np.sqrt(((middle - centres[i]) ** 2).sum(axis=1)) + radii[i]
        return np.where(open_ & (np.arange(n) != i), np.maximum(own, other), np.inf)

    cost = np.stack([joint(i) for i in range(n)])
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(cost)), n)
        radii[i] = cost[i, j]
        centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        trees[i] = [trees[i], trees[j]]
        open_[j] = False
        cost[j] = cost[:, j] = np.inf
        cost[i] = cost[:, i] = joint(i)
    return trees[int(np.flatnonzero(open_)[0])]


def _divided(group: np.ndarray, points: np.ndarray) -> list | np.ndarray:
    """The group as a leaf, or as a tree of its own anchors."""
    if len(group) <= LEAF:
        return group
    owned = place_anchors(points[group], max(2, math.isqrt(len(group))))
    if len(owned) == 1:  # equal points
        return group
    return _merged([group[o] for o in owned], points)


@dataclass(frozen=True)
class MetricTree:
    """Points in leaf order; nodes in breadth-first order, the children of a node adjacent."""

    order: np.ndarray
    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray  # first child, 0 for a leaf
    centres: np.ndarray
    radii: np.ndarray
    sums: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> MetricTree:
        root = _divided(np.arange(len(points)), points)
        order: list[np.ndarray] = []
        spans: dict[int, tuple[int, int]] = {}
        at, stack = 0, [(root, False)]
        while stack:  # leaf order, and what every node covers
            node, done = stack.pop()
            if isinstance(node, np.ndarray):
                spans[id(node)] = at, at + len(node)
                at += len(node)
                order.append(node)
            elif done:
                spans[id(node)] = spans[id(node[0])][0], spans[id(node[1])][1]
            else:
                stack += [(node, True), (node[1], False), (node[0], False)]
        nodes, child = [root], []
        for node in nodes:  # grows while it is read
            leaf = isinstance(node, np.ndarray)
            child.append(0 if leaf else len(nodes))
            if not leaf:
                nodes.extend(node)
        placed = np.concatenate(order)
        own = points[placed]
        first, last = (np.array([spans[id(n)][i] for n in nodes]) for i in (0, 1))
        total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(own.astype(np.int64), axis=0)])
        sums = total[last] - total[first]
        centres = sums / (last - first)[:, None]
        radii = np.array([np.sqrt(((own[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(first, last, centres)])
        return MetricTree(placed, own, first, last, np.array(child), centres, radii * (1 + 1e-9) + 1e-6, sums)

    def assign(self, entries: np.ndarray, owned, near) -> None:
        """Call ``owned(nodes, entry)`` for wholly owned balls, ``near(first, last, entry of each point)`` for leaves' points."""
        squares = (entries ** 2).sum(axis=1)
        exact = 4 * entries.shape[1] * max(np.abs(entries).max(), np.abs(self.points).max()) ** 2 < 2 ** 53
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        while len(nodes):
            away = np.sqrt(np.maximum(squares - 2 * self.centres[nodes] @ entries.T + (self.centres[nodes] ** 2).sum(axis=1)[:, None], 0))
            slack = 1e-6 * (1 + away)
            least = np.where(open_, away, np.inf).min(axis=1)
            open_ = open_ & (away - slack <= (least + 2 * self.radii[nodes])[:, None])
            left = open_.sum(axis=1)
            if (left == 1).any():
                single = left == 1
                owned(nodes[single], open_[single].argmax(axis=1))
            leaf = (left > 1) & (self.child[nodes] == 0)
            for node, candidates in zip(nodes[leaf], open_[leaf]):
                a, b = self.first[node], self.last[node]
                some = np.flatnonzero(candidates)
                if exact:
                    d = squares[some] - 2 * self.points[a:b] @ entries[some].T
                else:
                    d = ((self.points[a:b, None].astype(np.int64) - entries[some].astype(np.int64)) ** 2).sum(axis=2)
                near(a, b, some[d.argmin(axis=1)])
            inner = (left > 1) & (self.child[nodes] > 0)
            nodes = (self.child[nodes[inner], None] + np.arange(2)).ravel()
            open_ = np.repeat(open_[inner], 2, axis=0)

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = np.abs(self.points).max(initial=0) < 2 ** 15
        fields = {k: v.astype(np.int16 if k == "points" and small else np.int32) if k in ("points", "order", "first", "last", "child") else v
                  for k, v in vars(self).items()}
        np.savez(out, **fields)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> MetricTree:
        with np.load(io.BytesIO(raw)) as z:
            fields = {k: z[k] for k in z.files}
        return MetricTree(**fields | {"points": fields["points"].astype(np.float64)})


def _trees(rows: DataFrame, width: int, parts: int, scale: int, limit: int) -> DataFrame:
    """One row for each block of vectors: ids, labels and the trees of the parts."""
    step = width // parts

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = integers(matrix(part.column(2), width), scale, limit)
                trees = [MetricTree.build(values[:, p * step:(p + 1) * step]).dump() for p in range(parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.string())),
                     pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    return written(rows.mapInArrow(build, "ids array<long>, labels array<string>, trees array<binary>"), "metric-trees")


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: entries replaced by the floored means of what is nearest to them."""
    shared = trees.sparkSession.sparkContext.broadcast(books)  # entries x width numbers
    parts, (k, step) = len(books), books[0].shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        sums, n = np.zeros((parts, k, step), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for blobs in batch.column(0):
                for p, blob in enumerate(blobs):
                    tree = MetricTree.load(blob.as_py())

                    def owned(nodes: np.ndarray, entry: np.ndarray) -> None:
                        np.add.at(sums[p], entry, tree.sums[nodes])
                        np.add.at(n[p], entry, tree.last[nodes] - tree.first[nodes])

                    def near(a: int, b: int, entry: np.ndarray) -> None:
                        np.add.at(sums[p], entry, tree.points[a:b].astype(np.int64))
                        np.add.at(n[p], entry, 1)

                    tree.assign(entries[p], owned, near)
        part, entry = np.nonzero(n)
        moved = sums[part, entry]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), *(pa.array(moved[:, i]) for i in range(step))],
            ["part", "entry", "n", *(f"s{i}" for i in range(step))])

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(step))
    totals = trees.select("trees").mapInArrow(add_up, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(step)))
    out = [b.copy() for b in books]
    for row in totals.collect():  # at most parts x entries rows
        out[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(step)]
    return out


def _codes(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, code, error, label) by the final codebooks."""
    shared = trees.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for batch in batches:
            for ids, labels, blobs in zip(*batch.columns):
                codes = np.zeros((len(ids), len(blobs)), np.int64)
                error = np.zeros(len(ids), np.int64)
                for p, blob in enumerate(blobs):
                    tree = MetricTree.load(blob.as_py())
                    code = np.zeros(len(ids), np.int64)  # in leaf order

                    def owned(nodes: np.ndarray, entry: np.ndarray) -> None:
                        for node, e in zip(nodes, entry):
                            code[tree.first[node]:tree.last[node]] = e

                    def near(a: int, b: int, entry: np.ndarray) -> None:
                        code[a:b] = entry

                    tree.assign(entries[p], owned, near)
                    away = ((tree.points.astype(np.int64) - entries[p].astype(np.int64)[code]) ** 2).sum(axis=1)
                    codes[tree.order, p] = code
                    error[tree.order] += away
                digits = np.char.mod("%02x", codes)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(["".join(d) for d in digits.tolist()], pa.string()), pa.array(error), labels.values], ["vec_id", "code", "error", "label"])

    return trees.mapInArrow(encode, RESULT)


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position, in decimal."""
    numbers = np.concatenate([b.ravel() for b in books]) if books else np.empty(0)
    return hashlib.sha256(",".join(str(int(x)) for x in numbers).encode()).hexdigest()


def train_codebooks(vectors: DataFrame, trees: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int, limit: int) -> list[np.ndarray]:
    """The codebooks after all rounds, started from the vectors with the smallest ids."""
    head = vectors.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector")
    first = integers(matrix(pa.array([r["vector"] for r in head.collect()], pa.list_(pa.float64())), width), scale, limit)
    step = width // parts
    books = [first[:, p * step:(p + 1) * step].copy() for p in range(parts)]
    for _ in range(rounds):
        books = _round(trees, books)
    return books


def encode_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4,
                   entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector.

    ``label`` is compared as text; label_error adds up the errors of equal labels, nulls together.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    rows = vectors.where(usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    width = max(parts, -(-widest(rows, "vector") // parts) * parts)
    limit = 1 << (61 - math.ceil(math.log2(width))) // 2
    trees = _trees(spread(rows), width, parts, scale, limit)
    if trees.isEmpty():
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = train_codebooks(rows, trees, width, parts, entries, rounds, scale, limit)
    coded = written(_codes(trees, books).withColumn("of", F.concat(F.when(F.col("label").isNull(), "n").otherwise("v"), F.coalesce("label", F.lit("")))), "codes")
    totals = written(coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("size")), "label-errors")
    size = totals.agg(F.count("*").alias("n"), F.sum("size").alias("rows"), F.max(F.length("of")).alias("width")).first()
    return lookup(coded, totals, "of", table_rows=size["n"], row_bytes=64 + 4 * size["width"], salt_on="vec_id", weight="size",
                  weight_total=size["rows"]).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
