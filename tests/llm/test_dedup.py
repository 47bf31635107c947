"""Jaccard classes, window dedup and the hash helper against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexsieve.llm import forest_join, graph, rolling, substring_dedup
from lexsieve.llm.graph import components
from lexsieve.plans.scale import written
from tests.llm.conftest import SCHEMA, rows_of, sentence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def classes_of(rows):
    """(class, links, copies) of each id by comparing all pairs."""
    key = {i: tuple(words_of(t)) or (t or "") for i, t in rows}
    sets = {k: ({k[j:j + 5] for j in range(len(k) - 4)} or {k}) if isinstance(k, tuple) else set() for k in key.values()}
    keys = list(sets)
    near = {k: [o for o in keys if o != k and sets[k] and 5 * len(sets[k] & sets[o]) >= 4 * len(sets[k] | sets[o])] for k in keys}
    group = {k: k for k in keys}
    for k in keys:  # flood
        seen, todo = {k}, [k]
        while todo:
            for o in near[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        group[k] = seen
    return {i: (min(j for j in key if key[j] in group[k]), len(near[k]), sum(key[j] == k for j, _ in rows)) for i, k in key.items()}


def test_word_and_window_hashes():
    data, offsets = rolling.text_buffer(pa.array(["a bc  a", None, "", "bc a bc a", "é a"]))
    words = rolling.cut_words(data, offsets, rolling.GRAPHIC)
    assert [words.text(i).decode() for i in range(len(words.starts))] == ["a", "bc", "a", "bc", "a", "bc", "a", "é", "a"]
    assert words.doc.tolist() == [0, 0, 0, 3, 3, 3, 3, 4, 4] and words.first.tolist() == [0, 3, 3, 3, 7, 9]
    assert words.hashes[0] == words.hashes[2] == words.hashes[8] != words.hashes[1]
    at, codes = rolling.window_hashes(words, 2)
    assert at.tolist() == [0, 1, 3, 4, 5, 7] and codes[0] == codes[3] and codes[1] == codes[2] == codes[4]


def test_components_with_hub_loops_and_nulls(spark):
    edges = [(1, k) for k in range(2, 60)] + [(100, 101), (101, 102), (102, 103), (104, 103), (7, 7), (200, 200), (None, 5), (5, 1)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert all(found[k] == 1 for k in range(1, 60)) and all(found[k] == 100 for k in range(100, 105)) and found[200] == 200
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_take_few_rounds_and_few_tasks(spark, monkeypatch):
    """Edges that are stars already need no round; a chain's rounds read tables, not checkpoints of one task a partition."""
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or written(df, name))
    star = spark.createDataFrame([(k, 1) for k in range(2, 40)] + [(k, 50) for k in range(60, 70)], "a long, b long")
    assert dict(components(star, "a", "b").collect()) == {1: 1, **dict.fromkeys(range(2, 40), 1), 50: 50, **dict.fromkeys(range(60, 70), 50)}
    assert len(tables) == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 9)], "a long, b long")
    assert set(dict(components(chain, "a", "b").collect()).values()) == {1}
    assert 1 < len(tables) <= 6


def test_depth_is_shortened_to_the_target():
    assert forest_join.matched_depth(0.8, 18, 8, 0.9999) == 4
    assert forest_join.matched_depth(0.99, 18, 8, 0.9999) == 8


def test_agreement_leaves_the_target_recall():
    least = forest_join.least_agreement(0.8, 18, 8, 0.9999)
    below = sum(math.comb(144, k) * 0.8 ** k * 0.2 ** (144 - k) for k in range(least))
    assert 80 < least < 100 and (1 - 0.8 ** 4) ** 18 + below <= 1e-4


def test_unrelated_texts_do_not_chain_into_one_group(spark, monkeypatch):
    """Texts that share a notice, 0.4 of their shingles: trie nodes link them all, whole signatures keep them apart."""
    rng = random.Random(11)
    notice = sentence(rng, 30)
    texts = [notice + " " + sentence(rng, 20) for _ in range(200)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).select("doc_id", "text")
    nodes = forest_join.signed(docs, 5, 18, 8).select("node", "signature").cache()
    assert forest_join.candidate_groups(nodes, 0.8, 18, 8, 0.9999).count() == 0
    monkeypatch.setattr(forest_join, "least_agreement", lambda *_: 0)
    loose = forest_join.candidate_groups(nodes, 0.8, 18, 8, 0.9999)
    assert loose.groupBy("root").count().agg({"count": "max"}).first()[0] > 150


def test_large_trie_nodes_are_compared_in_blocks_and_tiles(spark, monkeypatch):
    """Two groups that share no text and a part of their shingles, more texts than a block or a tile holds."""
    rng = random.Random(4)
    texts = []
    for own in (sentence(rng, 70).split(), sentence(rng, 70).split()):
        for _ in range(60):
            changed = list(own)
            changed[rng.randrange(70)] = f"q{rng.randrange(40)}"
            texts.append(" ".join(changed))
    texts += texts[:3]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).select("doc_id", "text")
    want = classes_of(list(enumerate(texts)))
    monkeypatch.setattr(forest_join, "BLOCK_LEAVES", 16)
    monkeypatch.setattr(forest_join, "TILE", 5)
    found = forest_join.jaccard_classes(docs).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in found} == want


def test_grouped_rows_equal_plain_components():
    rng = np.random.default_rng(2)
    for split in (None, 9):
        values = rng.integers(0, 3, (23, 12)).astype(np.uint16)
        groups = np.sort(rng.integers(0, 15, 23)) * 7
        want = groups.copy()
        while True:
            old = want.copy()
            for i in range(23):
                for j in range(23):
                    apart = split is None or (i < split) != (j < split)
                    if groups[i] == groups[j] or (apart and (values[i] == values[j]).sum() >= 7):
                        want[i] = want[j] = min(want[i], want[j])
            if (old == want).all():
                break
        for tile in (4, 512):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(forest_join, "TILE", tile)
                assert (forest_join._grouped(groups, values, split, 7) == want).all()


def test_classes_match_all_pairs(spark, edge_docs, edge_texts):
    found = forest_join.jaccard_classes(edge_docs).collect()
    want = classes_of([(10 + i, t) for i, t in enumerate(edge_texts)] + [(16, edge_texts[6])])
    named = [r for r in found if r["doc_id"] is not None]
    assert len(named) == len(edge_texts) + 1
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in named} == want
    assert [tuple(r) for r in found if r["doc_id"] is None] == [(None, None, 0, 1)]
    kept = forest_join.one_of_each_class(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *(c for c, _, _ in want.values())}


def test_large_near_copy_group_is_counted_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = sentence(rng, 60).split()
    texts = [" ".join(base)]
    for _ in range(120):
        own = list(base)
        own[rng.randrange(60)] = f"q{rng.randrange(30)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    want = classes_of(list(enumerate(texts)))
    monkeypatch.setattr(forest_join, "BLOCK_NODES", 16)
    found = forest_join.jaccard_classes(docs).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in found} == want
    monkeypatch.setattr(forest_join, "BROADCAST_NODES", 0)
    again = forest_join.jaccard_classes(docs).collect()
    assert {r["doc_id"]: r["n_links"] for r in again} == {i: w[1] for i, w in want.items()}


def deduped(rows, size=20):
    """(words, removed, digest, kept words) by remembering every window in order."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for j in range(len(words) - size + 1):
            window = tuple(words[j:j + size])
            if window in seen:
                gone[j:j + size] = [True] * size
            seen.add(window)
        kept = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def test_window_dedup_matches_brute_force(spark, edge_docs, edge_texts, no_docs, monkeypatch):
    want = deduped([(10 + i, t) for i, t in enumerate(edge_texts)])
    for limit in (substring_dedup.BROADCAST_BYTES, 0):
        monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", limit)
        found = substring_dedup.dedup_report(edge_docs).collect()
        named = [r for r in found if r["doc_id"] is not None]
        assert len(named) == len(edge_texts) + 1
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in named} == {i: w[:3] for i, w in want.items()}
        assert [(r["n_words"], r["n_removed"]) for r in found if r["doc_id"] is None] == [(5, 0)]
    cut = substring_dedup.without_repeats(edge_docs)
    assert cut.schema == edge_docs.schema
    texts = {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] is not None}
    assert all(re.findall(r"[^\x20\x09-\x0D]+", t or "") == want[i][3] for i, t in texts.items())
    assert texts[10] is None and texts[15] == edge_texts[5]
    assert substring_dedup.dedup_report(no_docs).count() == 0 and substring_dedup.without_repeats(no_docs).count() == 0


def test_window_dedup_of_random_overlaps(spark):
    rng = random.Random(11)
    pool = [sentence(rng, rng.randint(18, 26)) for _ in range(12)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.6 else sentence(rng, 7) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5)
    found = substring_dedup.dedup_report(docs).collect()
    want = deduped(list(enumerate(texts)))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == {i: w[:3] for i, w in want.items()}


def test_ids_with_two_texts_have_a_defined_result(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 30), sentence(rng, 30)
    rows = [(1, a), (1, b), (2, a), (3, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "n", 7, "x", 1) for i, t in rows], SCHEMA)
    found = substring_dedup.dedup_report(docs).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [(1, 0), (1, 0), (2, 30), (3, 30)]


def test_anchor_of_equal_windows_is_equal():
    data, offsets = rolling.text_buffer(pa.array(["x " * 30, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(10, 40)))]))
    words = rolling.cut_words(data, offsets, rolling.GRAPHIC)
    at, found = substring_dedup._anchors(words, 20, 6)
    codes = rolling.window_hashes(words, 20)[1]
    by = {}
    for c, (place, h), start in zip(codes.tolist(), found.T.tolist(), at.tolist()):
        assert by.setdefault(c, (place - start, h)) == (place - start, h)
    assert len(np.unique(codes)) < len(codes)


def test_one_row_of_each_class_stays_whatever_ids_repeat(spark):
    rng = random.Random(4)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    near = a.replace(a.split()[0], "zz", 1)
    rows = [(1, a), (1, a), (2, a), (3, near), (1, b), (4, b), (5, c), (5, c), (5, near), (None, a), (6, "")]
    schema = "doc_id long, text string, _node long, _found string, _key int, n_chars long"
    docs = spark.createDataFrame([(i, t, 1, "f", 2, len(t)) for i, t in rows], schema).repartition(4)
    kept = forest_join.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (5, c), (None, a), (6, "")], key=str)
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_late_starts_of_many_slices_have_many_keys(spark, monkeypatch):
    rng = random.Random(6)
    passage = sentence(rng, 25)
    texts = [passage + " " + sentence(rng, 12) + " " + passage for _ in range(300)]
    docs = spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(20)
    survey = substring_dedup.surveyed(docs, 20, 6)
    anchors = survey.select("doc_id", "node", F.concat(F.transform("anchors", lambda a: F.shiftright(a, 32).cast("int"))).alias("wanted"))
    sent = substring_dedup.windows_of(docs.join(anchors, "doc_id").select("doc_id", "text", "wanted", "node"), 20, 6)
    keys = [r["count"] for r in sent.where("pos is null").groupBy("hash").count().collect()]
    assert len(keys) == 300 and max(keys) == 1
