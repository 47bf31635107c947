"""Quality and toxicity classifiers: closed forms, held-out accuracy, edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexsieve.llm import linear, quality, toxicity
from lexsieve.llm.linear import HashedText, Sparse, minimise, sigmoid
from tests.llm.conftest import SCHEMA, rows_of, sentence

SMALL = HashedText(bits=10, grams=True, echoes=True)


def dense(x):
    rows = [np.flatnonzero(r) for r in x]
    return Sparse(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), np.concatenate(rows), np.concatenate([v[r] for v, r in zip(x, rows)]), x.shape[1])


def test_minimise_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    found = minimise(lambda x: (float((x - 1) @ a @ (x - 1)), 2 * a @ (x - 1)), np.zeros(3), 200, tolerance=1e-14)
    assert np.allclose(found, 1, atol=1e-5)


def test_ordinal_fit_orders_thresholds_and_recovers_the_model():
    rng = np.random.default_rng(0)
    x, w, cuts = rng.normal(size=(4000, 3)), np.array([1.0, -2.0, 0.5]), np.array([-1.0, 0.5, 2.0])
    y = np.array([np.searchsorted(-sigmoid(s - cuts), -u) for s, u in zip(x @ w, rng.random(4000))])
    weights, found = quality.fit_ordinal(dense(x), y, 4, penalty=1e-8, steps=300)
    assert (np.diff(found) > 0).all()
    assert np.allclose(weights, w, atol=0.2) and np.allclose(found, cuts, atol=0.2)


def test_ordinal_gradient_is_right():
    rng = np.random.default_rng(1)
    x, y = dense(rng.normal(size=(50, 4))), rng.integers(0, 3, 50)
    seen = []
    original = quality.minimise
    try:
        quality.minimise = lambda loss, start, steps: seen.append((loss, start)) or start
        quality.fit_ordinal(x, y, 3)
    finally:
        quality.minimise = original
    loss, start = seen[0]
    p = start + rng.normal(size=len(start)) * 0.05
    g = loss(p)[1]
    for k in range(len(p)):
        e = np.eye(len(p))[k] * 1e-6
        assert abs((loss(p + e)[0] - loss(p - e)[0]) / 2e-6 - g[k]) < 1e-5


@pytest.fixture(scope="module")
def graded_docs(spark):
    rng = random.Random(8)
    texts = [" ".join(w + ("%%%" if k % 3 == 0 else "!" if k % 3 == 1 and rng.random() < 0.5 else "") for w in sentence(rng, 30).split()) for k in range(300)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    return docs, spark.createDataFrame([(k, k % 3) for k in range(300)] + [(None, 1), (5, None), (9999, 0), (6, 2)], "doc_id long, grade int")


def test_expected_grade_follows_the_ratings(spark, graded_docs):
    docs, ratings = graded_docs
    model = quality.train_ordinal(docs, ratings.where("coalesce(doc_id, 1) % 5 <> 0"), features=SMALL)
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1]
    held = quality.score_ordinal(docs, model, 1.0).where("doc_id % 5 = 0").collect()
    mean = [np.mean([r["expected_grade"] for r in held if r["doc_id"] % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert np.mean([(r["tail_probability"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held]) > 0.95


def test_quality_edge_cases(spark, graded_docs, edge_docs, no_docs):
    model = quality.train_ordinal(*graded_docs, features=SMALL)
    scored = quality.score_ordinal(edge_docs, model, 1.0)
    rows = scored.collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)
    empty = {r["tail_probability"] for r in rows if not r["text"]}
    assert len(empty) == 1
    assert quality.select_quality(edge_docs, model, 1.0, 0.0).schema == edge_docs.schema
    assert quality.score_ordinal(no_docs, model, 1.0).count() == 0
    with pytest.raises(ValueError, match="exist already"):
        quality.score_ordinal(scored, model, 1.0)
    lone = quality.train_ordinal(edge_docs, spark.createDataFrame([(10, 1)], "doc_id long, grade int"), features=SMALL)
    assert {r["tail_probability"] for r in quality.score_ordinal(edge_docs, lone, 1.0).collect()} == {1.0}
    nothing = quality.train_ordinal(no_docs, graded_docs[1], features=SMALL)
    assert quality.score_ordinal(edge_docs, nothing, 0.0).count() == edge_docs.count()


def test_nnpu_catches_held_out_toxic_texts(spark):
    rng = random.Random(4)
    insults = ["zounds", "fiend", "knave"]
    texts = [" ".join([*sentence(rng, 25).split(), *(rng.sample(insults, 2) if k % 6 == 0 else [])]) for k in range(1200)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(700)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train_toxic(docs, labels.where(~toxicity.held_out("doc_id")))
    rows = toxicity.score_toxic(docs, model).select("*", toxicity.held_out("doc_id").alias("out")).where("out").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in rows]) > 0.98


def test_non_negative_correction_keeps_the_risk_possible():
    rng = np.random.default_rng(3)
    positive, unlabelled = dense(np.eye(40)[rng.integers(0, 40, 30)]), dense(np.eye(40)[rng.integers(0, 40, 200)])
    w, b = toxicity.fit_nnpu(positive, unlabelled, 0.3, penalty=0, sparsity=0)
    minus = np.logaddexp(0, unlabelled.times(w) + b).mean() - 0.3 * np.logaddexp(0, positive.times(w) + b).mean()
    assert minus > -0.05


def test_toxicity_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(13, 1), (13, 0), (14, 0)], "doc_id long, toxic int")
    model = toxicity.train_toxic(edge_docs, labels)
    rows = toxicity.score_toxic(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxic(no_docs, model).count() == 0
    none = toxicity.train_toxic(edge_docs, labels.where("toxic = 0 and doc_id = 14"))
    assert {r["score"] for r in toxicity.score_toxic(edge_docs, none).collect()} == {0.0}
    assert toxicity.train_toxic(no_docs, labels.where("false")).intercept == -np.inf


def test_the_matrix_copies_no_row_but_into_itself():
    """Rows of the collected columns are views, in chunks, slices and any order; empty rows stay."""
    rows = [np.array(r, np.int32) for r in ([3, 5], [], [7], [1, 2, 4])]
    index = pa.chunked_array([pa.array([r.tobytes() for r in rows[:2]], pa.binary()), pa.array([b"xxxx"] + [r.tobytes() for r in rows[2:]], pa.binary())[1:]])
    value = pa.chunked_array([pa.array([r.astype(np.float32).tobytes() for r in rows], pa.binary())])
    assert all(not r.flags.owndata for r in linear._cells(index, np.int32) if len(r))
    x = linear.sparse_of(index, value, 8, np.array([3, 1, 0, 2]))
    assert x.index.tolist() == [1, 2, 4, 3, 5, 7] and x.bounds.tolist() == [0, 3, 3, 5, 6] and x.value.tolist() == x.index.tolist()
    assert linear.sparse_of(index, value, 8).index.tolist() == [3, 5, 7, 1, 2, 4]
