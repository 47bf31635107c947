"""N-gram Jaccard self-join of documents by a MinHash LSH forest with exact verification.

1. Texts with equal word sequences are one node; only nodes are compared, copies keep a membership row.
2. Each node has a signature of `trees` paths of `depth` MinHash values, kept as sortable bytes: a path is a leaf of
   the prefix trie of its tree, and nodes whose paths begin alike lie in one trie node. Leaves that share no prefix of
   the shortest length needed (see 3) with another one are dropped, the others are written once, ordered by tree and path.
3. Matched prefixes are shortened from `depth` values on, one value at a time, until ``1 - (1 - threshold^d)^trees``,
   the recall for the least similar wanted pair, reaches the target. At each length only those trie nodes are opened
   that hold more than one group so far and more than one child, because the pairs of a child were compared
   before. Inside an opened trie node whole signatures are compared; nodes that agree in as many values as a wanted pair
   does, but for the recall's slack, are put into one group. So unrelated texts that share some values of a path
   never chain into one candidate group.
4. Each group is cut into blocks of bounded size, every pair of blocks is one unit of work: sparse shingle
   sets become 0/1 columns and exact intersections come from one matrix product. Only link counts and one
   label per node leave a unit, never pairs. Large trie nodes are cut into blocks in the same way.

Shingles are `size` consecutive words (runs of letters, digits and non-ASCII characters, A-Z lower-cased).

Edge cases: a document of 1 to size-1 words has its whole word sequence as its only shingle; documents
without words are linked only to equal texts (null counts as empty); rows that repeat an id stay separate
rows; rows with a null id take no part and are returned with a null class and no links; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsieve.llm import rolling
from lexsieve.llm.graph import components
from lexsieve.plans.scale import spread, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 18
DEPTH = 8
TARGET_RECALL = 0.9999
#: Nodes and shingles of one block; a unit of work holds two blocks.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 20
#: Leaves of one block of a trie node, and of one tile whose signatures are compared at once.
BLOCK_LEAVES, TILE = 8192, 512
#: Bytes of one value of a path.
VALUE_BYTES = 2
#: Candidate nodes that are broadcast to the second text scan; more are joined by a shuffle.
BROADCAST_NODES = 500_000
_COLUMNS = 4096


def matched_depth(threshold: float, trees: int, depth: int, target: float) -> int:
    """Longest prefix whose match in any tree finds a pair of the threshold's similarity with the target recall."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def least_agreement(threshold: float, trees: int, depth: int, target: float) -> int:
    """Number of equal values of two signatures below which a pair of the threshold's similarity lies so seldom that
    recall stays above the target (at most once in a million where prefixes leave no slack)."""
    values, found = trees * depth, 1 - (1 - threshold ** matched_depth(threshold, trees, depth, target)) ** trees
    slack, below = max(found - target, 1e-6), 0.0
    for k in range(values + 1):
        below += math.comb(values, k) * threshold ** k * (1 - threshold) ** (values - k)
        if below > slack:
            return k
    return values


def _shingles(words: rolling.Words, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle occurrence, documents ascending."""
    at, codes = rolling.window_hashes(words, size)
    doc, first = words.doc[at], words.first
    few = np.diff(first)
    short = np.flatnonzero((few > 0) & (few < size))
    if len(short):
        whole = rolling.range_hashes(words.hashes, first[short], first[short + 1], 0x9FB21C651E98DF25)
        doc, codes = np.concatenate((doc, short)), np.concatenate((codes, whole))
        order = np.argsort(doc, kind="stable")
        doc, codes = doc[order], codes[order]
    return doc, codes


def _nodes(words: rolling.Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit id of the word sequence of each document; of the raw text where there is no word."""
    first = words.first
    of_words = rolling.sequence_hashes(words.hashes, first) ^ rolling.mix(np.diff(first).astype(np.uint64))
    of_text = rolling.byte_hashes(data, offsets[:-1], offsets[1:])
    return np.where(np.diff(first) > 0, of_words, of_text).view(np.int64)


def _signatures(doc: np.ndarray, codes: np.ndarray, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents with shingles, and their signatures: the low bits of each minimum, tree after tree."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros((0, trees * depth), np.uint16)
    bounds = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    short = (codes >> np.uint64(32)).astype(np.uint32)
    seed = np.random.default_rng(7).integers(0, 2**32, (2, trees * depth), dtype=np.uint32)
    values = np.empty((len(bounds), trees * depth), np.uint16)
    for k in range(trees * depth):
        values[:, k] = np.minimum.reduceat((short ^ seed[0, k]) * (seed[1, k] | np.uint32(1)), bounds).astype(np.uint16)
    return doc[bounds], values


def signed(documents: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, node, signature) of each document; the signature is null where there is no shingle."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text"):
                low = rolling.LOWER[data]
                words = rolling.cut_words(low, offsets, rolling.LOWER_ALNUM)
                doc, codes = _shingles(words, part.num_rows, size)
                some, values = _signatures(doc, codes, trees, depth)
                held: list[bytes | None] = [None] * part.num_rows
                for i, row in zip(some, values, strict=True):
                    held[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_nodes(words, data, offsets)), pa.array(held, pa.binary())],
                    ["doc_id", "node", "signature"])

    return documents.mapInArrow(sign, "doc_id long, node long, signature binary")


def _grouped(groups: np.ndarray, values: np.ndarray, split: int | None, least: int) -> np.ndarray:
    """Smallest group that each row's group is joined with, by rows that agree in `least` values or more.

    With `split` only rows of different sides are compared, for None all with all; tile against tile, and not
    where the two tiles are one group already.
    """
    now, end = groups.copy(), len(groups) if split is None else split
    tiles = [np.arange(a, min(a + TILE, end)) for a in range(0, end, TILE)]
    across = [np.arange(a, min(a + TILE, len(now))) for a in range(split or 0, len(now), TILE)]
    columns = np.ascontiguousarray(values.T)
    for i, left in enumerate(tiles):
        for right in across[i:] if split is None else across:
            both = left if left[0] == right[0] else np.concatenate((left, right))
            if (now[both] == now[both[0]]).all():
                continue
            agree = np.zeros((len(left), len(right)), np.uint16)
            for column in columns:
                agree += column[left][:, None] == column[right][None, :]
            old = now[both]
            linked = old[:, None] == old[None, :]
            if both is left:
                linked |= agree >= least
            else:
                linked[:len(left), len(left):] |= agree >= least
                linked[len(left):, :len(left)] |= (agree >= least).T
            names, first = np.unique(old, return_index=True)
            new = _smallest(old, linked)[first]
            at = np.minimum(np.searchsorted(names, now), len(names) - 1)
            now = np.where(names[at] == now, new[at], now)
    return now


def joined_groups(units: DataFrame, least: int) -> DataFrame:
    """(grp, label) of groups that meet in a unit of work; rows arrive sorted by unit."""
    def finish(key: tuple, held: list) -> pa.RecordBatch:
        held.sort(key=lambda h: h[1])  # side 0 first
        groups = np.array([h[0] for h in held], np.int64)
        values = np.frombuffer(b"".join(h[2] for h in held), np.uint16).reshape(len(held), -1)
        split = None if key[1] == key[2] else sum(h[1] == 0 for h in held)
        found = np.unique(np.column_stack((groups, _grouped(groups, values, split, least))), axis=0)
        found = found[found[:, 0] != found[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["grp", "label"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for own in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if own[:3] != key:
                    if held:
                        yield finish(key, held)
                    key, held = own[:3], []
                held.append(own[3:])
        if held:
            yield finish(key, held)

    return units.mapInArrow(work, "grp long, label long")


def _dealt(rows: DataFrame, key: str, *carried: str) -> DataFrame:
    """(key, low, high, carried..., side, payload) of each unit of two blocks, from rows with `block` and `blocks`."""
    mates = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("mate")
    units = rows.select(key, *carried, "block", mates).select(
        key, F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"), carried[0],
        (F.col("block") > F.col("mate")).cast("int").alias("side"), *carried[1:])
    return units.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def candidate_groups(nodes: DataFrame, threshold: float, trees: int, depth: int, target: float) -> DataFrame:
    """(node, root) of the nodes that share a group with another one, from (node, signature)."""
    shortest, least = matched_depth(threshold, trees, depth, target), least_agreement(threshold, trees, depth, target)
    width = depth * VALUE_BYTES
    paths = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("signature", t * width + 1, F.lit(width)))
    leaves = nodes.where("signature is not null").select("node", F.posexplode(paths).alias("tree", "path"))

    def prefix(d: int) -> Column:
        return F.xxhash64("tree", F.substring("path", 1, d * VALUE_BYTES))

    # equal hashes of different prefixes would only add a comparison
    leaves = leaves.withColumn("trie", prefix(shortest))
    shared = leaves.groupBy("trie").agg(F.count("*").alias("n")).where("n > 1").select("trie")
    leaves = written(leaves.join(shared, "trie").sortWithinPartitions("tree", "path"), "leaves")

    groups = None
    for level in range(depth, shortest - 1, -1):
        own = leaves.select("node", prefix(level).alias("trie"), F.substring("path", 1, (level + 1) * VALUE_BYTES).alias("child"))
        if groups is None:
            own = own.withColumn("grp", F.col("node"))
        else:
            own = own.join(groups, "node", "left").select("node", "trie", "child", F.coalesce("root", "node").alias("grp"))
        unsettled = F.min("grp") != F.max("grp")
        if level < depth:
            unsettled &= F.min("child") != F.max("child")
        opened = own.groupBy("trie").agg(F.count("*").alias("n"), unsettled.alias("unsettled")).where("unsettled").select(
            "trie", F.ceil(F.col("n") / BLOCK_LEAVES).alias("blocks"))
        inside = written(own.join(opened, "trie").select("trie", "node", "grp", "blocks"), f"trie-{level}")
        if inside.isEmpty():
            continue
        met = inside.join(nodes.select("node", "signature"), "node").withColumn(
            "block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        joined = written(joined_groups(_dealt(met, "trie", "grp", "signature"), least).distinct(), f"joined-{level}")
        edges = joined.select(F.col("grp").alias("node"), F.col("label").alias("root"))
        if edges.isEmpty():
            continue
        groups = written(components(edges if groups is None else groups.union(edges), "node", "root"), f"groups-{level}")
    return groups if groups is not None else nodes.select("node", F.col("node").alias("root")).limit(0)


def shingle_sets(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, node, wanted, group, shingles) with the sorted distinct shingle hashes as little-endian bytes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text"):
                low = rolling.LOWER[data]
                words = rolling.cut_words(low, offsets, rolling.LOWER_ALNUM)
                doc, codes = _shingles(words, part.num_rows, size)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sets = [np.unique(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(_nodes(words, data, offsets)),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "grp", "own", "n", "shingles"])

    return documents.mapInArrow(cut, "node long, grp long, own long, n long, shingles binary").where("own = node")


def _shared(sets: list[np.ndarray], split: int | None) -> np.ndarray:
    """Sizes of the intersections of the first `split` sets with the others; of all sets with all for None."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = count[column] > 1
    row, (_, column) = row[useful], np.unique(column[useful], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = slice(0, split), slice(split or 0, None)
    out = np.zeros((len(range(len(sets))[left]), len(range(len(sets))[right])), np.float32)
    for base in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (base, base + _COLUMNS))
        part = np.zeros((len(sets), min(_COLUMNS, int(column[-1]) + 1 - base)), np.float32)
        part[row[a:b], column[a:b] - base] = 1
        out += part[left] @ part[right].T
    return out


def _links(sets: list[np.ndarray], split: int | None, threshold: float) -> np.ndarray:
    """Which sets are similar; with `split` only across the two sides."""
    inter, n = _shared(sets, split), np.array([len(s) for s in sets], np.float64)
    a, b = n[:split], n[split or 0:]
    found = inter >= threshold * (a[:, None] + b[None, :] - inter) - 1e-9
    found &= (a[:, None] > 0) & (b[None, :] > 0)
    if split is None:
        np.fill_diagonal(found, False)
        return found
    linked = np.zeros((len(sets), len(sets)), bool)
    linked[:split, split:] = found
    linked[split:, :split] = found.T
    return linked


def _smallest(nodes: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Smallest node reachable over links, by repeated neighbourhood minima over node ranks."""
    order = np.argsort(nodes)
    linked = linked[np.ix_(order, order)]
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            out = np.empty_like(nodes)
            out[order] = nodes[order][label]
            return out
        label = new


def verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """(node, links, label) of each node in each unit of work; rows arrive sorted by unit.

    Two units never verify the same pair: a unit of two blocks compares across them, a unit of one block
    within it.
    """
    def unit(held_nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], lone: bool) -> pa.RecordBatch:
        _, first = np.unique(held_nodes, return_index=True)  # repeated rows of one document
        first = first[np.argsort(side[first], kind="stable")]
        nodes, sets = held_nodes[first], [sets[i] for i in first]
        linked = _links(sets, None if lone else int((side[first] == 0).sum()), threshold)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(linked.sum(axis=1).astype(np.int64)), pa.array(_smallest(nodes, linked))],
            ["node", "links", "label"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            raw = batch.column(5).to_pylist()
            for i in range(batch.num_rows):
                own = (columns[0][i], columns[1][i], columns[2][i])
                if own != key:
                    if held:
                        yield finish(key, held)
                    key, held = own, []
                held.append((columns[3][i], columns[4][i], raw[i]))
        if held:
            yield finish(key, held)

    def finish(key: tuple, held: list) -> pa.RecordBatch:
        sets = [np.frombuffer(s, np.uint64) for _, _, s in held]
        return unit(np.array([h[0] for h in held]), np.array([h[1] for h in held]), sets, key[1] == key[2])

    return blocks.mapInArrow(work, "node long, links long, label long")


def classed_rows(known: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                 target_recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, node, root, class_id, n_links, n_copies) of each row of (doc_id, text) with non-null ids.

    node stands for the word sequence and root for the class; class_id is the smallest id of the class.
    """
    rows = written(signed(known, size, trees, depth), "forest")

    nodes = written(rows.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("signature").alias("signature")), "nodes")
    groups = candidate_groups(nodes.select("node", "signature"), threshold, trees, depth, target_recall)

    wanted = nodes.select("node", "rep").join(groups.withColumnRenamed("root", "grp"), "node")
    wanted = written(wanted, "wanted")
    few = wanted.count() <= BROADCAST_NODES
    chosen = known.join(F.broadcast(wanted) if few else wanted, known["doc_id"] == wanted["rep"]).select("text", "node", "grp")
    # the text is column 0, so that shingle_sets finds node and group behind it
    sets = written(shingle_sets(chosen, size), "shingles")

    sizes = sets.groupBy("grp").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).alias("blocks"))
    own = sets.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = _dealt(own, "grp", "node", "shingles")
    checked = written(verified(dealt, threshold), "verified")

    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(checked.where("node <> label"), "node", "label")
    placed = nodes.select("node", "rep", "n_copies").join(links, "node", "left").join(roots, "node", "left").select(
        "node", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root"))
    placed = written(placed, "placed")
    least = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = placed.join(least, "root").select("node", "root", "class_id", "n_links", "n_copies")
    return rows.select("doc_id", "node").join(named, "node")


def jaccard_classes(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of each row.

    class_id is the smallest id of the documents joined by links or equal word sequences, n_links the number
    of different texts of similarity `threshold` or more, n_copies the rows with the same word sequence.
    """
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = classed_rows(spread(texts.where("doc_id is not null"), "doc_id"), **options).select("doc_id", "class_id", "n_links", "n_copies")
    nameless = texts.where("doc_id is null").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(nameless)


def _with_node(documents: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with the node of their text in a further column."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, text):
                words = rolling.cut_words(rolling.LOWER[data], offsets, rolling.LOWER_ALNUM)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_nodes(words, data, offsets))], [*part.schema.names, name])

    return documents.mapInArrow(add, T.StructType([*documents.schema.fields, T.StructField(name, T.LongType())]))


def one_of_each_class(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, with its own columns: of the smallest id and, under that id, of the smallest node.

    Rows are told apart by id and node, so of repeated rows one stays, and texts that share an id are judged each by its own
    class. Rows without an id stay.
    """
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(classed_rows(spread(texts.where("doc_id is not null"), "doc_id"), **options).select("doc_id", "node", "root"), "classed")
    leaders = rows.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("first.doc_id", "first.node")
    leads = leaders.groupBy("doc_id").agg(F.count("*").alias("leads"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).join(leads, "doc_id", "left")
    # an id with one row is settled by its id alone; of the others those that lead a class need a look at their texts
    unsettled = written(ids.where("leads is null or rows > 1").select(F.col("doc_id").alias(key), F.col("leads").isNotNull().alias("leads")), "later")
    sizes = unsettled.agg(F.count("*").alias("n"), F.count_if("leads").alias("several")).first()
    near = lambda table, n: F.broadcast(table) if n <= BROADCAST_NODES else table
    kept = documents.join(near(unsettled, sizes["n"]), key, "left_anti").select(*documents.columns)
    if not sizes["several"]:
        return kept
    name = next(n for n in ("_node" + "_" * k for k in range(len(documents.columns) + 1)) if n not in documents.columns)
    several = documents.join(near(unsettled.where("leads").select(key), sizes["several"]), key, "left_semi").select(*documents.columns)
    first = leaders.select(F.col("doc_id").alias(key), F.col("node").alias(name))
    chosen = _with_node(several, text, name).join(first, [key, name], "left_semi").dropDuplicates([key, name])
    return kept.unionByName(chosen.select(*documents.columns))
