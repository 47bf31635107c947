"""Best-fit packing of token sequences by bin completion.

Documents are encoded once into pieces of at most `capacity` tokens (a longer document is cut into full pieces
behind a first, shorter one). Only the number of pieces of each length matters for the packing, so the search
runs on a histogram of at most `capacity` counts, whatever the size of the corpus:

* the largest open length starts a bin; its undominated fillings are enumerated one after the other, least waste first and
  larger lengths first. Sets of sums that lengths up to each one can reach make every step lead to a filling. A filling is
  dominated, and left out, if an open length could take the place of some of its own and reach at least their sum;
* a filling is used as often as the counts allow, then fewer times; the next filling of the same length then comes later in
  the order, so that no set of bins is tried twice and none is left out;
* branch and bound: a node is cut off when its bins plus the waste bound of the rest (Martello and Toth's L2) reach the
  incumbent; the first incumbent is the best-fit-decreasing packing. The search ends at the bound, when nothing is left to
  try, or after `nodes` nodes; the result says which (`Packing.proved`).

Spark then ranks the pieces of each length (hot lengths are spread over parts, with offsets of counts) and looks
up the sequence and offset of each rank.

Edge cases: null texts are empty and consist of the end token alone; repeated rows and null ids are packed like
any other row; an empty table gives no sequences; extra columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.llm import rolling, token_encode
from lexsieve.plans.scale import spread, written

CAPACITY = 2048
#: Nodes of the search before it settles for its best packing.
SEARCH_NODES = 8_000
#: Nodes, the deepest ones, whose enumeration of fillings is kept.
ALIVE = 32
#: Parts over which the pieces of one length are ranked.
PARTS = 64

Filling = tuple[int, ...]


@dataclass(frozen=True)
class Packing:
    """Bins (lengths, how often), a lower bound of their number, and whether none with fewer bins exists."""

    bins: list[tuple[Filling, int]]
    bound: int
    proved: bool

    @property
    def used(self) -> int:
        return sum(times for _, times in self.bins)


def _up_to(mask: int, limit: int) -> int:
    return mask & ((2 << limit) - 1)


def _smeared(mask: int, by: int) -> int:
    """The mask or-ed with itself shifted by 1 to `by`."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        mask |= mask << step
        done += step
    return mask


class Fillings:
    """Undominated fillings of a gap from open counts, in falling order of (sum, lengths)."""

    def __init__(self, counts: np.ndarray, gap: int) -> None:
        self.gap = gap
        self.lengths = np.flatnonzero(counts[:gap + 1]).tolist()
        self.open = {n: min(int(counts[n]), gap // n) for n in self.lengths}
        self.more = {n: int(counts[n]) for n in self.lengths}
        reach, self.reach = 1, [1]  # sums of lengths up to each one
        for n in self.lengths:
            left, take = self.open[n], 1
            while left:  # 1, 2, 4, ... copies give every number of copies
                take = min(take, left)
                reach = _up_to(reach | reach << n * take, gap)
                left -= take
                take *= 2
            self.reach.append(reach)

    def _exact(self, total: int, below: int) -> Iterator[Filling]:
        """Fillings of this sum from the first `below` lengths, larger lengths first."""
        if not total:
            yield ()
            return
        for i in range(below - 1, -1, -1):
            n, rest = self.lengths[i], self.reach[i]
            if not self.reach[i + 1] >> total & 1:
                return  # no lengths up to this one give the sum
            for times in range(min(self.open[n], total // n), 0, -1):
                left = total - n * times
                if rest >> left & 1:
                    for tail in self._exact(left, i):
                        yield (n,) * times + tail

    def dominated(self, filling: Filling) -> bool:
        """Whether an open length outside could replace some of the filling's lengths and be no smaller than they are."""
        waste = self.gap - sum(filling)
        outside = sum(1 << n for n in self.lengths if self.more[n] > filling.count(n))
        ones = some = 0
        for n in filling:
            some |= (some | ones) << n  # sums of two or more
            ones |= 1 << n
        if outside & _smeared(some, waste):
            return True
        return bool(waste and outside & _smeared(ones, waste - 1) << 1)

    def __iter__(self) -> Iterator[Filling]:
        reach = self.reach[-1]
        while reach:
            total = reach.bit_length() - 1
            reach ^= 1 << total
            for filling in self._exact(total, len(self.lengths)):
                if not self.dominated(filling):
                    yield filling


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello-Toth L2: bins that the large lengths need, plus what the small ones need beyond their gaps."""
    n, half = np.arange(capacity + 1), capacity // 2
    number, weight = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(n * counts)))
    k = np.arange(half + 1)
    top = capacity - k + 1
    large = number[top] - number[half + 1]
    spare = large * capacity - (weight[top] - weight[half + 1])
    small = weight[half + 1] - weight[np.maximum(k, 1)]
    best = number[-1] - number[top] + large + np.maximum(0, -(-(small - spare) // capacity))
    return int(max(best.max(), -(-int(weight[-1]) // capacity)))


def _times(counts: np.ndarray, filling: Filling) -> int:
    return min(int(counts[n]) // filling.count(n) for n in set(filling))


def _take(counts: np.ndarray, filling: Filling, times: int) -> None:
    for n in filling:
        counts[n] -= times


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Fill each bin around the largest open length with the next largest that fits."""
    left, out = counts.copy(), []
    while left.any():
        chosen, gap, own = [], capacity, left.copy()
        while len(there := np.flatnonzero(own[:gap + 1])):
            n = int(there[-1])
            chosen.append(n)
            own[n] -= 1
            gap -= n
        filling = tuple(chosen)
        times = _times(left, filling)
        _take(left, filling, times)
        out.append((filling, times))
    return out


class _Level:
    """The choices at one node: bins around its largest open length, each as often as possible and then fewer times."""

    def __init__(self, left: np.ndarray, above: Filling | None) -> None:
        self.largest = int(np.flatnonzero(left)[-1])
        # bins of the same length come in falling order of their fillings
        self.after = above[1:] if above and above[0] == self.largest else None
        self.times, self.fillings = 0, None

    def rest(self) -> None:
        """Give up the enumeration; it is taken up behind the last filling when the search comes back."""
        self.fillings = None

    def next(self, left: np.ndarray, capacity: int) -> tuple[Filling, int] | None:
        if self.times > 1:
            self.times -= 1
            return (self.largest, *self.after), self.times
        if self.fillings is None:
            left[self.largest] -= 1
            self.fillings = iter(Fillings(left, capacity - self.largest))
            left[self.largest] += 1
        for filling in self.fillings:
            if self.after is None or (sum(filling), filling) < (sum(self.after), self.after):
                self.after = filling
                self.times = _times(left, (self.largest, *filling))
                return (self.largest, *filling), self.times
        return None


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> Packing:
    """The packing of a histogram of lengths, with the fewest bins that the search finds within `nodes` nodes."""
    left = counts.astype(np.int64).copy()
    bound = lower_bound(left, capacity)
    best = best_fit_decreasing(left, capacity)
    fewest, used = sum(t for _, t in best), 0
    chosen: list[tuple[Filling, int]] = []

    stack: list[_Level] = []
    descend, spent = fewest > bound, 0
    if descend:
        stack.append(_Level(left, None))
    while stack and fewest > bound and spent < nodes:
        if len(chosen) == len(stack):  # back from the subtree of the last choice
            filling, times = chosen.pop()
            _take(left, filling, -times)
            used -= times
        step = stack[-1].next(left, capacity)
        if step is None:
            stack.pop()
            continue
        spent += 1
        _take(left, *step)
        used += step[1]
        chosen.append(step)
        if not left.any():
            if used < fewest:
                best, fewest = list(chosen), used
        elif used + lower_bound(left, capacity) < fewest:
            stack.append(_Level(left, step[0]))
            if len(stack) > ALIVE:
                stack[-ALIVE - 1].rest()
    return Packing(best, bound, fewest == bound or not stack)


def encoded_pieces(documents: DataFrame, vocabulary: str, end_id: int, capacity: int, cache: int, slice_bytes: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of (doc_id, text)."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_encode.encoder(vocabulary, folds=False, cache=cache)
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text", slice_bytes):
                ids, bounds = tokens.encode(data, offsets)
                sizes = np.diff(bounds) + 1
                first = np.where(sizes % capacity == 0, capacity, sizes % capacity)
                n = 1 + (sizes - first) // capacity
                row = np.repeat(np.arange(part.num_rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                end = np.array([end_id], "<u4").tobytes()
                raw = ids.astype("<u4")
                sums = np.empty(len(row), np.int64)
                for k, (r, s, m) in enumerate(zip(row, start, length, strict=True)):
                    last = s + m == sizes[r]
                    crc = zlib.crc32(raw[bounds[r] + s:bounds[r] + s + m - int(last)])
                    sums[k] = zlib.crc32(end, crc) if last else crc
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _slots(bins: list[tuple[Filling, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of slots by length: (length, first rank of the run) keys, first sequence and offset of each run."""
    runs, base = [], 0
    for filling, times in bins:
        at = 0
        for n in filling:
            runs.append((n, base, at, times))
            at += n
        base += times
    table = np.array(runs, np.int64).reshape(-1, 4)
    order = np.lexsort((table[:, 2], table[:, 1], table[:, 0]))
    length, sequence, offset, times = table[order].T
    rank = np.cumsum(times) - times
    if len(length):
        head = np.searchsorted(length, length, side="left")
        rank = rank - rank[head]
    return length, rank, sequence, offset


def packed_sequences(documents: DataFrame, vocabulary: str, end_id: int, *, key: str = "doc_id", text: str = "text",
                     capacity: int = CAPACITY, nodes: int = SEARCH_NODES, cache: int = token_encode.CACHE_CHUNKS,
                     slice_bytes: int = token_encode.SLICE_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequences, least_sequences, proved) of each piece.

    The last three are the same in all rows: number of sequences, its lower bound, and whether fewer are known to be
    impossible. `cache` and `slice_bytes` bound a worker's memory, not the result.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(encoded_pieces(spread(texts), vocabulary, end_id, capacity, cache, slice_bytes), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    packing = complete_bins(counts, capacity, nodes)
    length, rank, sequence, offset = _slots(packing.bins)
    shared = spark.sparkContext.broadcast((length * (1 << 40) + rank, rank, sequence, offset))

    own = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int"))
    shares = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    offsets = shares.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = own.withColumn("local", local).join(F.broadcast(offsets), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, seq, off = shared.value
        for batch in batches:
            own_rank = batch.column(5).to_numpy()
            at = np.searchsorted(keys, batch.column(3).to_numpy() * (1 << 40) + own_rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(seq[at] + own_rank - first[at]), pa.array(off[at])],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    placed = ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.select("*", F.lit(packing.used).cast("long").alias("sequences"), F.lit(packing.bound).cast("long").alias("least_sequences"),
                         F.lit(packing.proved).alias("proved"))
