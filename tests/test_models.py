import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lexsieve.operators import boosted_trees
from lexsieve.operators import classifiers as clf
from lexsieve.operators import linear_solver as solver
from lexsieve.operators import naive_bayes as nb
from lexsieve.operators import ranking
from lexsieve.plans import matrix

FINANCE = ["petrobras lucro bolsa ações", "bolsa alta dólar juros", "selic juros banco central", "lucro banco trimestre",
           "dólar fecha alta bolsa", "ações petrobras sobem bolsa", "inflação juros selic", "mercado lucro ações"]
OTHER = ["time vence jogo final", "novela estreia elenco ator", "prefeito anuncia obra cidade", "jogo gol torcida time",
         "ator filme estreia festival", "hospital vacina saúde cidade", "escola aluno professor obra", "gol final campeonato jogo"]


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(1)
    rows, k = [], 0
    for split, pos, neg, day in (("train", 15, 45, 1), ("val", 5, 15, 2), ("test", 5, 15, 3)):
        for i in range(pos + neg):
            positive = i < pos
            text = " ".join(rng.sample(rng.choice(FINANCE if positive else OTHER).split(), 3) + rng.choice(FINANCE if positive else OTHER).split())
            category = "mercado" if positive else ("esporte", "ilustrada", "cotidiano", "saude")[i % 4]
            rows.append((k, split, text, int(positive), category, dt.datetime(2020, 1, day), f"l{k:04d}"))
            k += 1
    return spark.createDataFrame(rows, "doc_id bigint, split string, text string, label int, category string, date timestamp_ntz, link string")


@pytest.fixture(scope="module")
def toy(spark):
    """40 positives with integers 0-4, 60 negatives with 0-2, 20 columns."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.integers(0, 5, (40, 20)), rng.integers(0, 3, (60, 20))]).astype(float)
    y = np.array([1] * 40 + [0] * 60)
    rows = [(int(i), [float(v) for v in x[i]], int(y[i])) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, a array<double>, y int").withColumn("features", array_to_vector("a"))
    long = df.select(F.col("i").alias("doc_id"), "y", F.posexplode("a").alias("term_id", "value")).where("value > 0")
    return x, y, df, long


@pytest.mark.parametrize("kind", nb.KINDS)
@pytest.mark.parametrize("limit", [None, 0])
def test_naive_bayes_closed_form(toy, kind, limit):
    x, y, df, long = toy
    docs = df.withColumnRenamed("i", "doc_id")
    model = nb.fit_naive_bayes(long, docs, "y", kind)
    got = {r["doc_id"]: r["y_score"] for r in nb.score_naive_bayes(model, long, docs, "doc_id", 1, limit).collect()}
    counts = np.stack([x[y == c].sum(axis=0) for c in (0, 1)])
    if kind == "multinomial":
        w = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + 20))
        jll = x @ w.T + np.log(np.array([0.6, 0.4]))
    else:
        comp = counts.sum(axis=0) + 1 - counts
        jll = x @ (-np.log(comp / comp.sum(axis=1, keepdims=True))).T
    want = 1 / (1 + np.exp(jll[:, 0] - jll[:, 1]))
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(100))


def test_naive_bayes_document_without_terms_gets_the_prior(spark, toy):
    _, _, df, long = toy
    docs = df.withColumnRenamed("i", "doc_id")
    model = nb.fit_naive_bayes(long, docs, "y")
    lonely = spark.createDataFrame([(999,)], "doc_id int")
    got = nb.score_naive_bayes(model, long, lonely, "doc_id", 1).collect()
    assert [(r["doc_id"], round(r["y_score"], 12)) for r in got] == [(999, 0.4)]
    with pytest.raises(ValueError):
        nb.score_naive_bayes(model, long, docs, "doc_id", 7)


def test_logistic_regression_reaches_the_penalized_optimum(toy):
    x, y, df, _ = toy
    model = clf.train_logreg(df, label="y").model
    w, b = np.zeros(20), 0.0
    design = np.hstack([x, np.ones((100, 1))])
    penalty = np.diag([1.0] * 20 + [0.0])
    theta = np.append(w, b)
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ theta))
        grad = design.T @ (p - y) + penalty @ theta
        theta -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, grad)
    assert np.allclose(model.coefficients.toArray(), theta[:20], atol=1e-3) and math.isclose(model.intercept, theta[20], abs_tol=1e-2)


def test_calibrated_svc_scores_are_probabilities_and_repeatable(toy):
    _, y, df, _ = toy
    train = df.withColumn("link", F.col("i"))
    folded = clf.assign_folds(train, "y", ("link",))
    sizes = {(r["y"], r["fold"]): r["count"] for r in folded.groupBy("y", "fold").count().collect()}
    assert {sizes[1, f] for f in range(3)} <= {13, 14} and {sizes[0, f] for f in range(3)} == {20}
    one = {r["i"]: r["y_score"] for r in clf.train_calibrated_svc(train, order=("link",)).score(train).collect()}
    two = {r["i"]: r["y_score"] for r in clf.train_calibrated_svc(train, order=("link",)).score(train).collect()}
    assert all(0 <= p <= 1 for p in one.values()) and one == pytest.approx(two)
    assert np.mean([one[i] for i in range(40)]) > np.mean([one[i] for i in range(40, 100)]) + 0.3


def test_platt_scaling_matches_newton(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=60)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * m))).astype(int)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, m)], "y int, margin double")
    a, b = clf.fit_sigmoid(rows)
    p, n = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    design, theta = np.column_stack([m, np.ones(60)]), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-design @ theta))
        theta -= np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]), design.T @ (q - t))
    assert (a, b) == pytest.approx(tuple(theta), abs=1e-4)


def dense_optimum(x, y, loss, c, penalise_intercept):
    """Weights by damped Newton steps on the whole matrix."""
    design = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y, 1.0, -1.0)
    penalty = np.append(np.ones(x.shape[1]), float(penalise_intercept))
    w = np.zeros(design.shape[1])

    def parts(w):
        z = sign * (design @ w)
        if loss is solver.squared_hinge:
            short = np.maximum(0, 1 - z)
            return 0.5 * penalty @ (w * w) + c * (short ** 2).sum(), penalty * w - 2 * c * design.T @ (sign * short), 2 * c * (short > 0)
        p = 1 / (1 + np.exp(-z))
        return 0.5 * penalty @ (w * w) + c * np.logaddexp(0, -z).sum(), penalty * w - c * design.T @ (sign * (1 - p)), c * p * (1 - p)

    for _ in range(200):
        f, g, h = parts(w)
        way = -np.linalg.solve(design.T @ (design * h[:, None]) + np.diag(penalty) + 1e-12 * np.eye(len(w)), g)
        step = 1.0
        while parts(w + step * way)[0] > f + 1e-4 * step * g @ way and step > 1e-9:
            step /= 2
        w = w + step * way
    return w


@pytest.mark.parametrize("loss, penalised, memory", [
    (solver.squared_hinge, True, None), (solver.logistic, False, None),  # second derivatives fit
    (solver.squared_hinge, True, 5), (solver.logistic, False, 9)])  # five problems at a time, all at once
def test_problems_solved_together_equal_dense_newton(toy, monkeypatch, loss, penalised, memory):
    x, _, df, _ = toy
    if memory:
        monkeypatch.setattr(solver, "WEIGHT_BYTES", 8 * 21 * memory)
    codes = np.arange(100) % 3 * (x[:, 0] > 1)
    rows = df.withColumn("cls", F.when(F.element_at("a", 1) > 1, F.col("i") % 3).otherwise(0)).withColumn("fold", F.col("i") % 2)
    problems = [(cls, f) for cls in range(3) for f in (None, 0, 1)]
    found = solver.solve_linear(rows.repartition(3), 20, problems, label="cls", fold="fold", loss=loss, c=0.5, penalise_intercept=penalised, tol=1e-5)
    assert found.converged.all() and found.largest_gradient.max() <= 1e-5 and (memory or found.scans < 20)
    for k, (cls, f) in enumerate(problems):
        used = np.ones(100, bool) if f is None else np.arange(100) % 2 != f
        want = dense_optimum(x[used], codes[used] == cls, loss, 0.5, penalised)
        assert np.allclose(found.weights[:, k], want, atol=1e-5)
    got = {r["i"]: r["m"] for r in rows.select("i", found.margins().alias("m")).collect()}
    assert np.allclose(np.array([got[i] for i in range(100)]), np.hstack([x, np.ones((100, 1))]) @ found.weights)


def test_sparse_dense_and_empty_vectors_are_one_kind(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.sparse(4, [1, 3], [2.0, -1.0]), 1), (Vectors.dense([0, 2.0, 0, -1.0]), 1), (Vectors.sparse(4, [], []), 0), (Vectors.dense([1.0, 0, 0, 3.0]), 0)]
    frame = spark.createDataFrame(rows * 3, ["features", "y"]).coalesce(1)
    found = solver.solve_linear(frame, 4, [(1, None)], tol=1e-9)
    want = dense_optimum(np.array([v.toArray() for v, _ in rows * 3]), np.array([y for _, y in rows * 3]), solver.squared_hinge, 1.0, True)
    assert np.allclose(found.weights[:, 0], want, atol=1e-8)
    nothing = solver.solve_linear(frame.where("y > 5"), 4, [(1, None)])
    assert not nothing.weights.any()


def test_folds_do_not_move_vectors_and_keep_equal_rows_together(spark):
    frame = spark.createDataFrame([(i // 2, i % 7 == 0, [0.5] * 3) for i in range(100)], "k int, y boolean, features array<double>")
    folded = clf.assign_folds(frame, "y", ("k",), 4)
    by_key = {}
    for r in folded.collect():
        by_key.setdefault((r["y"], r["k"]), set()).add(r["fold"])
    assert all(len(f) == 1 for f in by_key.values())
    sizes = folded.groupBy("y", "fold").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes if not r["y"]) <= 24
    assert "features" not in str(folded._jdf.queryExecution().optimizedPlan()).split("Join")[-1].split("fold")[-1]


def test_sigmoids_of_all_groups_equal_single_fits(spark):
    rng = np.random.default_rng(7)
    rows = [(g, int(rng.random() < 1 / (1 + np.exp(-(g - 1) * m - 0.3))), float(m)) for g in range(4) for m in rng.normal(size=50) * 3]
    frame = spark.createDataFrame(rows, "g int, y int, margin double")
    found = clf.fit_sigmoids(frame, ["g"])
    for g in range(4):
        assert found[g,] == pytest.approx(clf.fit_sigmoid(frame.where(F.col("g") == g)), abs=1e-7)


def test_matrix_runs_and_leakage(articles):
    scheme = "top7_plus_other"
    features = matrix.build_features(articles, "tfidf", min_df=1)
    runs = matrix.run_matrix(features, ["multinomialnb", "logreg"], [("binary", None), ("multiclass", scheme)], dt.datetime(2026, 1, 2, 3, 4, 5))
    assert [r.run_id for r in runs] == [f"20260102-030405__gen1__{m}__tfidf-raw-{t}" for t in ("bin", "mc8") for m in ("multinomialnb", "logreg")]
    pred = matrix.all_predictions(runs)
    assert pred.where("split = 'test'").groupBy("run_id").count().select("count").distinct().collect()[0][0] == 20
    assert pred.where("y_score < 0 or y_score > 1 or y_pred not in (0, 1)").count() == 0
    areas = ranking.average_precision(pred.where("split = 'test'"), ["run_id"]).collect()
    assert all(r["pr_auc"] > 0.8 for r in areas)
    changed = articles.withColumn("text", F.when(F.col("split") == "test", "bolsa selic").otherwise(F.col("text"))).withColumn(
        "label", F.when(F.col("split") == "test", 1 - F.col("label")).otherwise(F.col("label")))
    again = matrix.build_features(changed, "tfidf", min_df=1)
    assert sorted(again.vocabulary.table.collect()) == sorted(features.vocabulary.table.collect())
    rerun = matrix.run_matrix(again, ["multinomialnb"], [("binary", None)], dt.datetime(2026, 1, 2))
    assert rerun[0].decision == runs[0].decision


def test_trees_and_embeddings(spark, articles):
    features = matrix.build_features(articles, "bow", min_df=1)
    scores = matrix.score_model(features, "lightgbm", trees=3)
    assert scores.count() == 40 and scores.where("y_score < 0 or y_score > 1").count() == 0
    words = sorted({w for t in FINANCE + OTHER for w in t.split()})
    finance = {w for t in FINANCE for w in t.split()}
    vectors = spark.createDataFrame([(w, [1.0 if w in finance else -1.0, 0.5]) for w in words], "token string, vec array<float>")
    dense = matrix.build_features(articles, "fasttext", vectors=(vectors, len(words), 2))
    truth = dense.docs.where("split = 'test'").select("doc_id", F.col("label").alias("y_true"))
    scored = truth.join(matrix.score_model(dense, "linearsvc"), "doc_id")
    assert ranking.average_precision(scored, []).first()["pr_auc"] > 0.8
    with pytest.raises(ValueError, match="negative"):
        matrix.score_model(dense, "multinomialnb")


def test_one_versus_rest_calibration(articles):
    features = matrix.build_features(articles, "bow", min_df=1)
    scores = matrix.score_model(features, "linearsvc", "multiclass", {"keep": ("mercado", "esporte"), "sink": "outros"})
    rows = features.docs.where("split = 'test'").select("doc_id", F.col("label").alias("y_true")).join(scores, "doc_id")
    assert rows.where("y_score < 0 or y_score > 1").count() == 0
    assert ranking.average_precision(rows, []).first()["pr_auc"] > 0.8


@pytest.mark.parametrize("args", [
    ("other", ["logreg"], "binary", None), ("bow", ["xgb"], "binary", None), ("bow", ["logreg"], "ternary", None),
    ("bow", ["logreg"], "binary", "top7_plus_other"), ("bow", ["logreg"], "multiclass", None)])
def test_matrix_checks(args):
    with pytest.raises(ValueError):
        matrix.check_models(*args)


def test_length_of_a_step_is_where_the_slope_is_gone():
    """Slopes 4 (t - at): beyond the whole step, before it, near enough to it, and a minimum beyond all lengths."""
    at = np.array([2.3, 0.07, 1.01, 50.0, 1e-5])
    slopes, values = 4 * (solver.LENGTHS[:, None] - at), 2 * (solver.LENGTHS[:, None] - at) ** 2
    assert np.allclose(solver._best_lengths(values, slopes), [2.3, 0.07, 1.0, 8.0, 1e-5])


def test_logistic_regression_on_classes_is_the_softmax_optimum(spark, toy):
    x, _, df, _ = toy
    code = np.arange(100) % 3 * (x[:, 0] > 0)
    rows = df.join(spark.createDataFrame([(i, int(k)) for i, k in enumerate(code)], "i int, code int"), "i")
    model = clf.train_logreg(rows.coalesce(1), 2, label="code", tol=0.05)
    design, hit = np.hstack([x, np.ones((100, 1))]), np.eye(3)[code]
    w = model.model.weights
    p = np.exp(design @ w)
    p /= p.sum(axis=1, keepdims=True)
    gradient = design.T @ (p - hit) + np.vstack([w[:-1], np.zeros(3)])
    assert np.abs(gradient).max() <= 0.051  # the problem is convex
    got = {r["i"]: r["y_score"] for r in model.score(rows).collect()}
    assert np.allclose([got[i] for i in range(100)], p[:, 2])


def test_rows_of_one_class_have_a_certain_score(toy):
    _, _, df, _ = toy
    for label, code, want in ((1, 1, 1.0), (0, 0, 1.0), (2, 0, 0.0)):
        model = clf.train_logreg(df.limit(9).withColumn("y", F.lit(label)), code)
        assert {r["y_score"] for r in model.score(df.limit(5)).collect()} == {want}
    with pytest.raises(ValueError):
        clf.train_logreg(df.where("i < 0"))


def wide_rows(spark, n=120, parts=1):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((n, 12)) < 0.4, rng.integers(-2, 6, (n, 12)), 0).astype(float)
    x[:, 0], x[:, 11] = rng.normal(size=n), x[:, 10]  # many values; two equal columns
    y = (x[:, 1] + 2 * x[:, 0] + rng.normal(size=n) > 1.2).astype(int)
    rows = [(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "i int, a array<double>, y int").withColumn("features", array_to_vector("a")).repartition(parts).cache()


def test_boosted_trees_equal_those_of_spark(spark, monkeypatch):
    """Negative, repeated and many values; in several parts, ranges and with margins written on the way too."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    df = wide_rows(spark)
    fitted = GBTClassifier(labelCol="_y", maxIter=4, maxDepth=3, stepSize=0.1).fit(df.withColumn("_y", F.col("y").cast("double")))
    wanted = dict(fitted.transform(df).select("i", vector_to_array("probability")[1]).collect())
    for k in range(2):
        got = dict(clf.train_boosted_trees(df, trees=4, depth=3).score(df.select("i", "features")).select("i", "y_score").collect())
        assert max(abs(got[i] - wanted[i]) for i in wanted) < 1e-9
        df = wide_rows(spark, parts=3)
        for name, value in (("PART_BYTES", 1), ("RANGE_BINS", 40), ("REFRESH", 2), ("BLOCK_ROWS", 10)):
            monkeypatch.setattr(boosted_trees, name, value)


def test_rows_of_boosted_trees_take_room_by_their_terms(spark):
    """A row of 50,000 columns with one term is packed into one bin, not into one for each column; one class only is no error."""
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(i, i % 2, Vectors.sparse(50_000, [7 + i % 2], [1.0])) for i in range(20)], ["i", "y", "features"])
    bins = boosted_trees.find_bins(df, 20, 50_000)
    packed = boosted_trees._packed(df, "y", spark.sparkContext.broadcast(bins))
    assert len(bins.thresholds) == 50_002 and sum(len(r["bins"]) for r in packed.collect()) == 4 * 20
    model = clf.train_boosted_trees(df, trees=2, depth=2)
    scores = {r["i"] % 2: r["y_score"] for r in model.score(df).collect()}
    assert scores[1] > 0.85 and scores[0] < 0.15
    same = clf.train_boosted_trees(df.where("y = 1"), trees=2, depth=2).score(df).collect()
    assert all(r["y_score"] > 0.85 for r in same)
    with pytest.raises(ValueError):
        clf.train_boosted_trees(df.withColumn("y", F.lit(None).cast("int")), trees=1)


@pytest.mark.parametrize("loss, c, scans", [(solver.squared_hinge, 100.0, 220), (solver.logistic, 1.0, 150)])
def test_long_rows_do_not_lengthen_the_way(spark, monkeypatch, loss, c, scans):
    """Counts of texts of very different lengths, for the hinge in unit rows: the estimate from rows and the rising c keep the scans few."""
    draw = np.random.default_rng(5)
    share = 1.0 / np.arange(1, 121)
    x = np.stack([draw.poisson(n * share / share.sum()) for n in np.exp(draw.uniform(2, 9, 240))]).astype(float)
    y = x[:, 50:60].sum(axis=1) + draw.poisson(1.0, 240) > 0.05 * x.sum(axis=1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if loss is solver.squared_hinge else x
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "a array<double>, y int").select("y", array_to_vector("a").alias("features"))
    monkeypatch.setattr(solver, "WEIGHT_BYTES", 8 * 121)
    found = solver.solve_linear(rows.repartition(2), 120, [(1, None)], loss=loss, c=c, tol=1e-6)
    assert found.converged.all() and found.scans < scans
    want = dense_optimum(x, y, loss, c, True)
    assert np.allclose(found.weights[:, 0], want, atol=1e-5)
