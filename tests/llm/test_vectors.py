"""Operators on embeddings against brute force, on clusters, ties, copies and edge rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsieve.llm import grid_order_join, hard_negatives, vector_codes
from lexsieve.llm.vectors import integers

SCHEMA = "vec_id long, embedding array<double>, label int, cell string, node long, key string, part int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "c", 9, "k", 1, 0.5) for i, v, l in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    """Clusters of near copies, chains just above and below the threshold, exact and scaled copies, ties, bad rows."""
    rng = np.random.default_rng(3)
    rows = [list(map(float, v)) for v in rng.normal(size=(150, 12))]
    for centre in rng.normal(size=(4, 12)):
        rows += [list(map(float, centre + rng.normal(size=12) * s)) for s in rng.uniform(0.01, 0.35, 25)]
    rows += [rows[3], rows[3], [2 * x for x in rows[3]], [-x for x in rows[3]], rows[160], rows[160]]
    rows += [[float(x) for x in v] for v in rng.integers(-1, 2, (40, 12))]  # many equal scores
    rows += [None, [0.0] * 12, [math.nan] * 12, [math.inf] + [0.0] * 11, [None] + [1.0] * 11, [], [1.0, 2.0], [1e-200] * 12, rows[0], rows[0]]
    labels = rng.integers(0, 4, len(rows)).tolist()
    labels[7] = labels[170] = None
    return [(i, v, l) for i, (v, l) in enumerate(zip(rows, labels))] + [(5, rows[5], labels[5]), (6, rows[90], 1), (None, rows[8], 2)]


def padded(v, width=12):
    return np.array(v + [0.0] * (width - len(v)))


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def classes_by_pairs(rows, cosine):
    units = {}
    for at, (i, v, _) in enumerate(rows):
        if i is not None and good(v) and any(v):
            x = padded(v)
            x = x / np.abs(x).max()
            units[at] = x / np.linalg.norm(x)
    near = {a: [b for b in units if a != b and units[a] @ units[b] >= cosine] for a in units}
    out = []
    for at, (i, _, _) in enumerate(rows):
        seen, todo = {at}, [at]
        while todo:
            for b in near.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(rows[b][0] for b in seen) if i is not None else None
        out.append((i, len(near.get(at, [])), least, i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [1, 128])
def test_cosine_classes_equal_all_pairs(spark, vectors, monkeypatch, run):
    monkeypatch.setattr(grid_order_join, "RUN", run)  # several runs of blocks, or one
    monkeypatch.setattr(grid_order_join, "BLOCK", 16)
    monkeypatch.setattr(grid_order_join, "LEAF", 4)
    found = grid_order_join.cosine_classes(frame(spark, vectors))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == classes_by_pairs(vectors, 0.95)


def test_cosine_classes_of_a_clustered_table(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 64))
    data = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=64) * (0.05 + 0.25 * (i % 7) / 7)], 0) for i in range(700)]
    found = grid_order_join.cosine_classes(frame(spark, data))
    units = np.array([v for _, v, _ in data])
    units /= np.linalg.norm(units, axis=1)[:, None]
    counts = (units @ units.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in found.collect()}
    assert counts.sum() > 1000 and [got[i].n_links for i in range(700)] == counts.tolist()


def test_skipped_intervals_are_more_than_eps_apart():
    rng = np.random.default_rng(1)
    units = grid_order_join.unit_rows(np.concatenate([rng.normal(size=(300, 6)), np.ones((90, 6)) + rng.normal(size=(90, 6)) * 0.05]))
    axes = grid_order_join.principal_axes(units, 3)
    units = units[np.lexsort(np.floor(units @ axes / 0.3).T[::-1])]
    make = lambda part, at: grid_order_join.Sequence(np.arange(len(part)), np.ones(len(part), int), part, axes, at)
    a, b = make(units[:300], 0), make(units[300:], 300)
    i, j = grid_order_join.near_leaves(a, b, 0.3)
    assert 0 < len(i) == len(set(zip(i, j))) < len(a.boxes[0][0]) * len(b.boxes[0][0])
    near = set(zip(i.tolist(), j.tolist()))
    for x, y in zip(*np.nonzero(np.linalg.norm(units[:300, None] - units[None, 300:], axis=2) <= 0.3)):
        assert (x // grid_order_join.LEAF, y // grid_order_join.LEAF) in near


def codes_by_definition(rows, parts, entries, rounds, scale, width):
    kept = sorted(((i, padded(v, width), l) for i, v, l in rows if good(v)), key=lambda r: (r[0] is None, r[0] or 0, tuple(r[1])))
    points = np.array([np.floor(scale * v) for _, v, _ in kept]).astype(int)
    step = width // parts
    codes, error, books = [], 0, []
    for p in range(parts):
        part = points[:, p * step:(p + 1) * step]
        book = part[:entries].copy()
        for r in range(rounds + 1):
            d = ((part[:, None] - book[None]) ** 2).sum(axis=2)
            code = d.argmin(axis=1)
            if r < rounds:
                for e in set(code.tolist()):
                    own = part[code == e]
                    book[e] = [int(x) // len(own) for x in own.sum(axis=0)]
        codes.append(code)
        error = error + d.min(axis=1)
        books += book.ravel().tolist()
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    of = {}
    for (_, _, l), e in zip(kept, error):
        of[l] = of.get(l, 0) + int(e)
    return sorted(((i, "".join("%02x" % c[k] for c in codes), int(error[k]), of[l], digest) for k, (i, _, l) in enumerate(kept)), key=str)


@pytest.mark.parametrize("entries", [5, 256])
def test_vector_codes_equal_plain_integer_means(spark, vectors, entries):
    found = vector_codes.encode_vectors(frame(spark, vectors), entries=entries)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == codes_by_definition(vectors, 4, entries, 4, 1024, 12)


def test_vector_codes_of_large_components_and_one_label_for_most_rows(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=8) * 60_000], None if i % 50 else 1) for i in range(400)]
    found = vector_codes.encode_vectors(frame(spark, data), entries=16)
    assert sorted(map(tuple, found.collect()), key=str) == codes_by_definition(data, 4, 16, 4, 1024, 8)


@pytest.mark.parametrize("spread, apart", [(0.05, True), (0.05, False), (1.0, False)])
def test_metric_tree_owns_and_assigns_like_all_distances(spread, apart):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    points = np.floor(1024 * (centres[rng.integers(0, 30, 3000)] + spread * rng.normal(size=(3000, 16))))
    points[500:900] = points[500]
    entries = np.floor(1024 * centres) if apart else np.concatenate([points[:60], points[:4]])  # some equal
    tree = vector_codes.MetricTree.load(vector_codes.MetricTree.build(points).dump())
    assert sorted(tree.order.tolist()) == list(range(3000)) and (points[tree.order] == tree.points).all()
    got, whole = np.full(3000, -1), 0

    def owned(nodes, entry):
        nonlocal whole
        for n, e in zip(nodes, entry):
            got[tree.first[n]:tree.last[n]] = e
            whole += tree.last[n] - tree.first[n]
            assert (tree.sums[n] == tree.points[tree.first[n]:tree.last[n]].sum(axis=0)).all()

    def near(a, b, entry):
        got[a:b] = entry

    tree.assign(entries, owned, near)
    assert (got[np.argsort(tree.order)] == ((points[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert whole > 2900 if apart else whole > 0 or spread == 1.0  # an entry in each tight cluster: cached sums do it all


def negatives_by_definition(rows, scale, step):
    kept = [(i, np.floor(scale * padded(v)), l) for i, v, l in rows if i is not None and l is not None and good(v)]
    out = []
    for i, a, l in kept:
        if i % step:
            continue
        scored = sorted(((-int(a @ v), j, m) for j, v, m in kept if j != i))
        for p, j, _ in [s for s in scored if s[2] == l][:5]:
            inside = [(s, k) for s, k, m in scored if m != l and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_hard_negatives_equal_all_scores(spark, vectors, block):
    found = hard_negatives.hard_negatives(frame(spark, vectors), F.col("vec_id") % 5 == 0, block=block)
    assert found.schema.simpleString() == "struct<" + hard_negatives.RESULT.replace(" long", ":bigint").replace(" int", ":int").replace(", ", ",") + ">"
    assert sorted(map(tuple, found.collect())) == negatives_by_definition(vectors, 256, 5)


def test_spanning_tree_bounds_hold_and_leave_candidates_unscored():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16))
    make = lambda n: integers(np.repeat(centres, n, axis=0) + 0.05 * rng.normal(size=(8 * n, 16)), 256, 1 << 20)
    points, rows = make(12), make(60)
    parent, edge = hard_negatives.spanning_tree(points)
    order = hard_negatives.light_first(parent)
    seen = set()
    for a in order.tolist():
        assert parent[a] in seen or parent[a] == -1
        seen.add(a)
    dense = np.linalg.norm(points[:, None] - points[None], axis=2)
    joined, total = {0}, 0.0
    while len(joined) < len(points):  # Prim on the full matrix
        best = min((dense[i, j], j) for i in joined for j in range(len(points)) if j not in joined)
        total += best[0]
        joined.add(best[1])
    assert len(seen) == len(points) and math.isclose(edge.sum(), total, rel_tol=1e-6)
    tree = hard_negatives.AnchorTree(np.arange(96), np.zeros(96), points, parent, edge, order)
    scores, met = rows @ points.T, 0
    low = {a: np.quantile(scores[:, a], 0.95) for a in range(96)}

    def found(a, hits, s):
        nonlocal met
        met += len(hits)
        assert (scores[hits, a] == s).all() and set(np.flatnonzero(scores[:, a] >= low[a])) <= set(hits.tolist())

    tree.sweep(rows, lambda a: np.ones(len(rows), bool), lambda a: (low[a], math.inf), found)
    assert met < 0.6 * scores.size


@pytest.mark.parametrize("rows", [[], [(100, None, 1), (101, [math.nan], 2)]])
def test_tables_without_usable_vectors(spark, rows):
    empty = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    assert sorted(map(tuple, grid_order_join.cosine_classes(empty).collect())) == [(i, 0, i, True) for i, _, _ in rows]
    assert vector_codes.encode_vectors(empty).collect() == []
    assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 100 == 0).collect() == []
