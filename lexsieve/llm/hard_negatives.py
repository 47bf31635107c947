"""Hard negatives of anchors, searched along a spanning tree of the anchors.

The score of a row is its integer inner product with an anchor. Anchors are laid out in blocks of bounded size; a
minimum spanning tree of each block is built in its own task. A block then visits all rows, wherever they lie, with its
tree broadcast:

* the score at a child anchor differs from the one at its parent by at most edge length times norm of the row, so an
  interval for every row follows from its parent's, which holds the exact score wherever that was taken;
* only rows whose interval meets the anchor's window are scored anew. The window of the first pass starts at the
  worst of the best positives so far, the one of the second spans the shares of the positive scores asked for and
  rises with the negatives found so far;
* children with small subtrees come first, so the intervals of at most log2(anchors) nodes are alive at a time.

Tasks keep a fixed number of rows for each anchor (and positive), which meet in one small shuffle. Nothing is emitted
for pairs outside that.

Edge cases: rows with a null id, label or vector, or with null or non-finite components, take no part; an empty table or
one without anchors gives no rows. Shorter vectors count as followed by zeros. Repeated rows and rows that share an id
are rows of their own, but a row is never a partner of an anchor with its own id; two anchor rows of one id give the
result rows of both. Equal scores order by id. Integers saturate where sums of products would leave the exact range of
doubles (at +-2^23 for 64 components). Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexsieve.llm.vectors import integers, matrix, usable, widest
from lexsieve.plans.scale import global_index, new_folder, spread, written

#: Anchors of one block: 2 MB of vectors of 64 components, a tree of 4096^2 distances.
BLOCK_ANCHORS = 4096
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge length) of each point in a minimum spanning tree rooted at point 0, whose parent is -1."""
    n = len(points)
    squares = np.einsum("ij,ij->i", points, points)
    parent, near = np.full(n, -1), np.full(n, np.inf)
    open_ = np.ones(n, bool)
    now = 0
    for _ in range(n - 1):
        open_[now] = False
        away = np.maximum(squares + squares[now] - 2.0 * (points @ points[now]), 0.0)
        closer = open_ & (away < near)
        near[closer], parent[closer] = away[closer], now
        now = int(np.argmin(np.where(open_, near, np.inf)))
    # the difference of squares may round below the true length
    edge = np.zeros(n)
    edge[1:] = np.sqrt(((points[1:] - points[parent[1:]]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return parent, edge


def light_first(parent: np.ndarray) -> np.ndarray:
    """Nodes in preorder, children with smaller subtrees first."""
    children: list[list[int]] = [[] for _ in parent]
    for node, above in enumerate(parent.tolist()):
        if above >= 0:
            children[above].append(node)
    preorder, stack = [], [0] if len(parent) else []
    while stack:
        node = stack.pop()
        preorder.append(node)
        stack.extend(children[node])
    weight = np.ones(len(parent), np.int64)
    for node in reversed(preorder):
        if parent[node] >= 0:
            weight[parent[node]] += weight[node]
    order, stack = [], [0] if len(parent) else []
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(sorted(children[node], key=lambda c: -weight[c]))
    return np.array(order, np.int64)


@dataclass(frozen=True)
class AnchorTree:
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    order: np.ndarray

    def sweep(self, rows: np.ndarray, eligible: Callable[[int], np.ndarray], window: Callable[[int], tuple[float, float]],
              found: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
        """Call ``found`` for every anchor with the eligible rows that can lie in its window, and their scores."""
        if not len(rows):
            return
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        left = np.bincount(self.parent[1:], minlength=len(self.parent))
        alive: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for a in self.order.tolist():
            above = int(self.parent[a])
            low, high = window(a)
            if above < 0:
                scores = rows @ self.points[a]
                alive[a] = scores, scores
                hits = np.flatnonzero(eligible(a) & (scores >= low) & (scores <= high)) if low <= high else np.empty(0, np.int64)
                taken = scores[hits]
            else:
                reach = self.edge[a] * norms + 0.5  # scores are integers, half of one covers rounding
                floor, ceiling = alive[above][0] - reach, alive[above][1] + reach
                left[above] -= 1
                if not left[above]:
                    del alive[above]
                hits, taken = np.empty(0, np.int64), np.empty(0)
                if low <= high:
                    hits = np.flatnonzero(eligible(a) & (ceiling >= low) & (floor <= high))
                    if 2 * len(hits) > len(rows):
                        floor = ceiling = rows @ self.points[a]
                        taken = floor[hits]
                    else:
                        taken = rows[hits] @ self.points[a]
                        floor[hits] = ceiling[hits] = taken
                if left[a]:
                    alive[a] = floor, ceiling
            if len(hits):
                found(a, hits, taken)


class _Best:
    """The first k (score, id) of each of n lists, higher scores and then smaller ids first."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = [np.empty(0) for _ in range(n)]
        self.ids = [np.empty(0, np.int64) for _ in range(n)]

    def worst(self, i: int) -> float:
        return self.scores[i][-1] if len(self.scores[i]) == self.k else -math.inf

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.worst(i)
        scores, ids = np.concatenate([self.scores[i], scores[keep]]), np.concatenate([self.ids[i], ids[keep]])
        first = np.lexsort((ids, -scores))[:self.k]
        self.scores[i], self.ids[i] = scores[first], ids[first]

    def table(self, *names: str) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        at = np.repeat(np.arange(len(sizes)), sizes)
        scores = np.concatenate([*self.scores, np.empty(0)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(scores), pa.array(np.concatenate([*self.ids, np.empty(0, np.int64)]))], list(names))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each list over all tasks, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _anchor_blocks(anchors: DataFrame, width: int, scale: int, limit: int, size: int) -> tuple[DataFrame, int]:
    """One row for each block of anchors in id order, with its tree; and the number of blocks."""
    numbered = global_index(anchors, ["id", "label", "vector"], "at").withColumn("block", F.floor(F.col("at") / size).cast("long"))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("at")
        points = integers(matrix(table.column("vector").combine_chunks(), width), scale, limit)
        parent, edge = spanning_tree(points)
        fields = (table.column("id").to_numpy(), table.column("label").to_numpy(), points, parent, edge, light_first(parent))
        arrays = [pa.array([np.ascontiguousarray(f).tobytes()], pa.binary()) for f in fields]
        return pa.Table.from_arrays([table.column("block").slice(0, 1).combine_chunks(), *arrays], ["block", "ids", "labels", "points", "parent", "edge", "order"])

    trees = written(numbered.groupBy("block").applyInArrow(
        build, "block long, ids binary, labels binary, points binary, parent binary, edge binary, order binary"), "anchor-trees")
    return trees, trees.count()


def _load(row, width: int) -> AnchorTree:
    ids = np.frombuffer(row["ids"], np.int64)
    return AnchorTree(ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["points"]).reshape(len(ids), width),
                      np.frombuffer(row["parent"], np.int64), np.frombuffer(row["edge"]), np.frombuffer(row["order"], np.int64))


def _block_result(spark: SparkSession, rows: DataFrame, tree: AnchorTree, width: int, scale: int, limit: int,
                  positives: int, negatives: int, least: tuple[int, int]) -> DataFrame:
    """Result rows of the anchors of one block; two scans of the rows."""
    shared = spark.sparkContext.broadcast(tree)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            yield (batch.column(0).to_numpy(), batch.column(1).to_numpy(),
                   integers(matrix(batch.column(2), width), scale, limit))

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = _Best(len(anchors.ids), positives)
        for ids, labels, points in parts(batches):
            anchors.sweep(points, lambda a: (labels == anchors.labels[a]) & (ids != anchors.ids[a]),
                          lambda a: (best.worst(a), math.inf), lambda a, hits, s: best.add(a, s, ids[hits]))
        yield best.table("anchor", "score", "id")

    top = _first(rows.mapInArrow(find_positives, "anchor long, score long, id long"), ["anchor"], positives).select(
        "anchor", "rank", "score", "id").collect()  # at most `positives` for each anchor of the block
    own = np.full((len(tree.ids), positives, 2), -1, np.int64)
    known = np.zeros(len(tree.ids), np.int64)
    for r in top:
        own[r["anchor"], r["rank"] - 1] = r["score"], r["id"]
        known[r["anchor"]] = max(known[r["anchor"]], r["rank"])
    positive = spark.sparkContext.broadcast((own, known))
    numerator, denominator = least

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (scored, n) = shared.value, positive.value
        most = scored[:, :, 0]
        fewest = -(-most * numerator // denominator)
        best = _Best(len(anchors.ids) * positives, negatives)

        def window(a: int) -> tuple[float, float]:
            spans = [(max(fewest[a, j], best.worst(a * positives + j)), most[a, j]) for j in range(n[a]) if fewest[a, j] <= most[a, j]]
            return (min(s[0] for s in spans), max(s[1] for s in spans)) if spans else (1.0, 0.0)

        for ids, labels, points in parts(batches):
            def add(a: int, hits: np.ndarray, scores: np.ndarray) -> None:
                for j in range(n[a]):
                    inside = np.flatnonzero((scores >= fewest[a, j]) & (scores <= most[a, j]))
                    if len(inside):
                        best.add(a * positives + j, scores[inside], ids[hits[inside]])

            anchors.sweep(points, lambda a: labels != anchors.labels[a], window, add)
        yield best.table("list", "score", "id")

    found = _first(rows.mapInArrow(find_negatives, "list long, score long, id long"), ["list"], negatives)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (scored, _) = shared.value, positive.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            mine = scored[at // positives, at % positives]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.ids[at // positives]), pa.array(mine[:, 1]), batch.column(1), batch.column(2), pa.array(mine[:, 0]), batch.column(3)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return found.select("list", "rank", "id", "score").mapInArrow(name, RESULT)


def hard_negatives(vectors: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   scale: int = 256, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (4, 5),
                   block: int = BLOCK_ANCHORS) -> DataFrame:
    """Per anchor and positive the best rows of other labels scoring between ``least`` (a fraction) and all of the positive's score.

    ``anchor`` is a condition on the columns of ``vectors``; labels and ids are integers. Positives are the best other
    rows of the anchor's label. Every block of anchors costs two scans of the table; each pass sends one block to the tasks.
    """
    spark = vectors.sparkSession
    there = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    width = max(1, widest(there, "vector"))
    limit = 1 << (53 - math.ceil(math.log2(width + 1))) // 2
    trees, n = _anchor_blocks(there.where("anchor").drop("anchor"), width, scale, limit, block)
    rows = spread(there.drop("anchor"))
    path = new_folder(spark, "hard-negatives")
    for at in range(n):
        tree = _load(trees.where(F.col("block") == at).first(), width)  # one bounded block
        _block_result(spark, rows, tree, width, scale, limit, positives, negatives, least).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path) if n else spark.createDataFrame([], RESULT)
