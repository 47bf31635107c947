"""Near copies of vectors by cosine, as an epsilon grid order join.

Unit vectors of cosine c lie at a distance of sqrt(2 - 2c) = eps. The vectors are rotated to principal axes, cut into
grid cells of width eps on the leading ones and sorted by their cells (the grid order). The sorted sequence is stored in
blocks with bounding boxes. A bounded run of blocks at a time is sent to all tasks, which join it with the blocks not before it:

* sequence intervals are halved together; a pair of intervals whose boxes are more than eps apart is skipped;
* what is left of leaf intervals is compared on the leading axes, a projection that never lengthens distances;
* surviving pairs are verified by cosine in double precision on the whole vectors.

Equal vectors are one node, however many copies there are. Tasks emit link counts and one connected neighbour for each node,
never pairs; a group of different near copies still costs the product of its blocks, which counting its links needs.

The axes are fitted on a bounded sample and steer the cost only: boxes and projections hold for any orthonormal axes.

Edge cases: null and zero vectors, vectors with null or non-finite components and rows with a null id link with nothing and
are kept; an empty table gives no rows. Shorter vectors count as followed by zeros. Repeated rows and rows that share an
id are vectors of their own that link like others; all rows whose id leads a component are kept. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.llm.graph import components
from lexsieve.llm.vectors import matrix, usable
from lexsieve.plans.scale import lookup, new_folder, partitions, spread, written

#: Rows of a block, of a leaf interval, and blocks sent to the tasks at a time (32 MB of vectors of 64 doubles).
BLOCK, LEAF, RUN = 512, 128, 128
#: Leading axes of boxes and of the projection; vectors that the axes are fitted on.
AXES, SAMPLE = 16, 8192
#: Bytes of vectors in one part of the sorted sequence at most; parts are never fewer than the session's shuffle partitions.
PART_BYTES = 128 << 20
LISTS = ["nodes", "copies", "h1", "h2"]
#: Pairs verified at a time.
PAIRS = 1 << 16
#: Covers rounding of single precision in the projected comparison.
SLACK = 1e-4


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of length one; scaling first keeps squares within range."""
    top = np.abs(values).max(axis=1, keepdims=True)
    scaled = values / np.where(top > 0, top, 1)
    return scaled / np.sqrt(np.maximum(np.einsum("ij,ij->i", scaled, scaled), 1e-300))[:, None]


def principal_axes(sample: np.ndarray, axes: int) -> np.ndarray:
    """The leading principal axes of the sample as columns, orthonormal for any sample."""
    centred = sample - sample.mean(axis=0) if len(sample) else np.zeros((1, sample.shape[1]))
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, ::-1][:, :axes]


class Sequence:
    """Consecutive blocks of the grid order with a pyramid of bounding boxes; level 0 holds the leaves."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, units: np.ndarray, axes: np.ndarray, at: int) -> None:
        self.nodes, self.copies, self.units, self.at = nodes, copies, units, at
        lead = units @ axes
        half = (lead ** 2).sum(axis=1, keepdims=True) / 2
        # left . right = -|a - b|^2 / 2 on the leading axes
        one = np.ones_like(half)
        self.left = np.hstack([lead, -half, one]).astype(np.float32)
        self.right = np.hstack([lead, one, -half]).astype(np.float32)
        starts = np.arange(0, len(nodes), LEAF)
        low, high = np.minimum.reduceat(lead, starts), np.maximum.reduceat(lead, starts)
        self.boxes = [(low, high)]
        while len(low) > 1:
            pairs = np.arange(0, len(low), 2)
            low, high = np.minimum.reduceat(low, pairs), np.maximum.reduceat(high, pairs)
            self.boxes.append((low, high))

    def leaf(self, i: int) -> slice:
        return slice(i * LEAF, min((i + 1) * LEAF, len(self.nodes)))


def near_leaves(a: Sequence, b: Sequence, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (of a, of b) that are not provably more than eps apart, halving the intervals of both together."""
    i = j = np.zeros(1, np.int64)
    for level in range(max(len(a.boxes), len(b.boxes)) - 1, -1, -1):
        for seq, at in ((a, 0), (b, 1)):
            if level < len(seq.boxes) - 1:  # this interval has halves at this level
                half = (i, j)[at][:, None] * 2 + np.arange(2)
                there = half < len(seq.boxes[level][0])
                kept = np.repeat(((j, i)[at])[:, None], 2, axis=1)[there]
                i, j = (half[there], kept) if at == 0 else (kept, half[there])
        (low_a, high_a), (low_b, high_b) = (s.boxes[min(level, len(s.boxes) - 1)] for s in (a, b))
        gap = np.maximum(0, np.maximum(low_a[i] - high_b[j], low_b[j] - high_a[i]))
        near = (gap ** 2).sum(axis=1) <= eps * eps + SLACK
        i, j = i[near], j[near]
    return i, j


def links(a: Sequence, b: Sequence, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows (of a, of b) with the row of a before that of b in the whole order."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    least = np.float32(-(eps * eps + SLACK) / 2)
    i, j = near_leaves(a, b, eps)
    order = np.argsort(j, kind="stable")
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.diff(j)) + 1
    for some in np.split(np.arange(len(i)), cuts):
        if not len(some):
            continue
        right = b.leaf(int(j[some[0]]))
        rows = np.concatenate([np.arange(a.leaf(k).start, a.leaf(k).stop) for k in i[some].tolist()])
        rows = rows[rows + a.at < right.stop - 1 + b.at]
        step = max(1, (1 << 21) // LEAF)
        for at in range(0, len(rows), step):
            mine = rows[at:at + step]
            close = a.left[mine] @ b.right[right].T >= least
            x, y = np.nonzero(close)
            x, y = mine[x], y + right.start
            earlier = x + a.at < y + b.at
            x, y = x[earlier], y[earlier]
            for k in range(0, len(x), PAIRS):
                p, q = x[k:k + PAIRS], y[k:k + PAIRS]
                linked = np.einsum("ij,ij->i", a.units[p], b.units[q]) >= cosine
                if linked.any():
                    yield p[linked], q[linked]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the trees of linked nodes together, larger roots below smaller ones."""
    def root(x: np.ndarray) -> np.ndarray:
        while (parent[x] != x).any():
            x = parent[x]
        return x

    while len(a):
        a, b = root(a), root(b)
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    parent[:] = root(np.arange(len(parent)))


def _key(vector: str) -> list:
    """Two independent 64-bit hashes of the components; two of n vectors share both with a probability below n^2 / 2^129."""
    return [F.xxhash64(F.lit(1), vector).alias("h1"), F.xxhash64(F.lit(2), vector).alias("h2")]


def _stored_sequence(rows: DataFrame, axes: np.ndarray, width: int, eps: float, parts: int) -> DataFrame:
    """Distinct vectors in grid order, in blocks: part, block, low and high on the first axis, and per vector its smallest
    id (node), number of rows (copies), key, and components, which keep their precision."""
    classes = rows.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    shared = rows.sparkSession.sparkContext.broadcast(axes)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(matrix(batch.column(4), width))
            cells = np.clip(np.floor(units @ shared.value / eps), -32768, 32767).astype(np.int16)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = matrix(part.column(4), width)
                first = unit_rows(values) @ shared.value[:, 0]
                if pa.types.is_float32(part.column(4).type.value_type):
                    values = values.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(5).slice(0, 1), pa.array([block], pa.int64()), pa.array([first.min()]), pa.array([first.max()]),
                     *(pa.array([part.column(i).to_numpy()], pa.list_(pa.int64())) for i in range(4)), pa.array([values.tobytes()], pa.binary())],
                    ["part", "block", "low", "high", *LISTS, "vectors"])
                block += 1

    keyed = classes.select("node", "copies", *_key("vector"), "vector")
    kind = keyed.schema["vector"].dataType.simpleString()
    located = keyed.mapInArrow(locate, f"node long, copies long, h1 long, h2 long, vector {kind}, cell array<smallint>")
    laid = located.repartitionByRange(parts, "cell", "node").sortWithinPartitions("cell", "node")
    schema = "part int, block long, low double, high double, " + ", ".join(f"{c} array<long>" for c in LISTS) + ", vectors binary"
    return written(laid.select("node", "copies", "h1", "h2", "vector", F.spark_partition_id().alias("part")).mapInArrow(pack, schema), "grid-order")


def _sequence(rows: list, axes: np.ndarray, at: int, width: int) -> Sequence:
    nodes, copies = (np.concatenate([r[c] for r in rows]).astype(np.int64) for c in LISTS[:2])
    kinds = (np.float32 if len(r["vectors"]) == 4 * width * len(r["nodes"]) else np.float64 for r in rows)
    values = np.concatenate([np.frombuffer(r["vectors"], kind).reshape(-1, width) for r, kind in zip(rows, kinds)])
    return Sequence(nodes, copies, unit_rows(values.astype(np.float64)), axes, at)


def _runs(blocks: DataFrame) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """First and last (part, block) of each run of blocks, from one count per part."""
    counts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect())
    runs, first, have = [], None, 0
    for part, n in counts:
        at = 0
        while at < n:
            first = first or (part, at)
            take = min(RUN - have, n - at)
            at, have = at + take, have + take
            if have == RUN:
                runs.append((first, (part, at - 1)))
                first, have = None, 0
    if first:
        runs.append((first, (counts[-1][0], counts[-1][1] - 1)))
    return runs


def _place(part: str = "part", block: str = "block"):
    return F.shiftleft(F.col(part).cast("long"), 40) + F.col(block)


def _joined_run(spark: SparkSession, blocks: DataFrame, run: tuple, axes: np.ndarray, width: int, cosine: float) -> DataFrame:
    """(node, links, neighbour) of the nodes that the run's blocks and the blocks not before them link."""
    first, last = ((p << 40) + b for p, b in run)
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    own = blocks.where(_place().between(first, last)).orderBy("part", "block").collect()  # at most RUN blocks
    starts, at = {}, 0
    for r in own:
        starts[(r["part"] << 40) + r["block"]] = at
        at += len(r["nodes"])
    low, high = min(r["low"] for r in own), max(r["high"] for r in own)
    shared = spark.sparkContext.broadcast(([{k: r[k] for k in ("nodes", "copies", "vectors")} for r in own], starts, at, axes))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, offsets, n, lead = shared.value
        a = _sequence(rows, lead, 0, width)
        count, parent = np.zeros(n, np.int64), np.arange(n)
        names = ["node", "links", "neighbour"]
        for batch in batches:
            for row in batch.to_pylist():
                # a block of the run lies among its rows; a later one after all of them
                place = (row["part"] << 40) + row["block"]
                inside = offsets.get(place)
                b = _sequence([row], lead, n if inside is None else inside, width)
                mine, near = np.zeros(len(b.nodes), np.int64), np.full(len(b.nodes), -1)
                for x, y in links(a, b, cosine):
                    np.add.at(count, x, b.copies[y])
                    np.add.at(mine, y, a.copies[x])
                    if inside is None:
                        # rows of a that meet in a row of b are one component
                        fresh = near[y] < 0
                        near[y[fresh]] = x[fresh]
                        unite(parent, x, near[y])
                    else:
                        unite(parent, x, y + inside)
                if inside is None:
                    hit = np.flatnonzero(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(b.nodes[hit]), pa.array(mine[hit]), pa.array(a.nodes[near[hit]])], names)
                else:
                    count[inside:inside + len(mine)] += mine
        hit = np.flatnonzero((count > 0) | (parent != np.arange(n)))
        yield pa.RecordBatch.from_arrays([pa.array(a.nodes[hit]), pa.array(count[hit]), pa.array(a.nodes[parent[hit]])], names)

    reachable = blocks.where((_place() >= first) & (F.col("low") <= high + eps + SLACK) & (F.col("high") >= low - eps - SLACK))
    return reachable.drop("low", "high", "h1", "h2").mapInArrow(join, "node long, links long, neighbour long")


def cosine_classes(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector: links at a cosine of at least ``cosine``."""
    if not 0 < cosine < 1:
        raise ValueError("the cosine of a link lies between 0 and 1")
    spark = vectors.sparkSession
    links_here = F.col(key).isNotNull() & usable(vector) & F.exists(vector, lambda x: x != 0)
    rows = spread(vectors.select(F.col(key).cast("long").alias("id"), F.when(links_here, F.col(vector)).alias("vector")))
    there = rows.where("vector is not null")
    size = there.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width, found = size["width"] or 0, []
    if width:
        sample = there.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()  # bounded
        axes = principal_axes(unit_rows(matrix(pa.array([r["vector"] for r in sample], pa.list_(pa.float64())), width)), min(AXES, width))
        parts = max(partitions(spark), -(-size["n"] * width * 8 // PART_BYTES))
        blocks = _stored_sequence(there, axes, width, math.sqrt(2 - 2 * cosine), parts)
        path = new_folder(spark, "vector-links")
        for run in _runs(blocks):
            _joined_run(spark, blocks, run, axes, width, cosine).write.mode("append").parquet(path)
            found.append(run)
    if not found:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    linked = spark.read.schema("node long, links long, neighbour long").parquet(path)
    roots = components(linked, "node", "neighbour")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left")
    classes = blocks.select(F.explode(F.arrays_zip(*LISTS)).alias("c")).select(
        F.struct("c.h1", "c.h2").alias("key"), F.col("c.nodes").alias("node"), F.col("c.copies").alias("copies"))
    groups = written(classes.join(counts, "node", "left").where("copies > 1 or links > 0").select(
        "key", F.col("copies").alias("size"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root")), "vector-groups")
    n = groups.agg(F.count("*").alias("n"), F.sum("size").alias("rows")).first()
    keyed = rows.select("id", F.when(F.col("vector").isNotNull(), F.struct(*_key("vector"))).alias("key"))
    placed = lookup(keyed, groups, "key", table_rows=n["n"], row_bytes=64, salt_on="id", weight="size", weight_total=n["rows"])
    component = F.coalesce("root", "id")
    return placed.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                         component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
