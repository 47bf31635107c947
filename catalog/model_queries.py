"""Models on the labelled documents: exact naive Bayes, linear models, trees, the matrix."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from catalog.newton import newton_ctes, sigmoid_ctes
from catalog.registry import query
from catalog.text_queries import _UNI, _vocab_sql, term_vectors
from catalog.views import DOCS_POSITIVE, DOCS_SCHEME, WITH_DOCS, WITH_LABELLED, docs_split, r6
from lexsieve.operators import classifiers as clf
from lexsieve.operators import naive_bayes as nb
from lexsieve.operators import ranking
from lexsieve.operators.features import bag_of_words
from lexsieve.operators.linear_solver import logistic, solve_linear
from lexsieve.operators.vocabulary import fit_vocabulary
from lexsieve.operators import reports
from lexsieve.plans import matrix
from lexsieve.plans.experiment import Ledger, run_experiment
from lexsieve.plans.scale import durable, new_folder


_NB = f"""{WITH_LABELLED}, {_vocab_sql(_UNI)},
counts AS (SELECT doc_id, any_value(tok.split) AS split, term, count(*)::DOUBLE AS x FROM gram JOIN vocab USING (term) JOIN tok USING (doc_id) GROUP BY doc_id, term),
cls AS (SELECT label AS c, count(*) AS nc FROM split WHERE split = 'train' GROUP BY label),
ct AS (SELECT v.term, cls.c, coalesce(sum(counts.x), 0) AS n FROM vocab v CROSS JOIN cls
  LEFT JOIN (SELECT counts.*, split.label FROM counts JOIN split USING (doc_id) WHERE counts.split = 'train') counts ON counts.term = v.term AND counts.label = cls.c GROUP BY ALL),
tot AS (SELECT c, sum(n) AS nt FROM ct GROUP BY c), allt AS (SELECT term, sum(n) AS na FROM ct GROUP BY term),
consts AS (SELECT (SELECT count(*) FROM vocab) AS v, (SELECT sum(nt) FROM tot) AS s, (SELECT sum(nc) FROM cls) AS nd)
"""
_NB_SCORE = """jll AS (SELECT d.doc_id, cls.c, {prior} + coalesce(sum(counts.x * w.w), 0) AS j FROM (SELECT doc_id FROM split WHERE split <> 'train') d CROSS JOIN cls CROSS JOIN consts
  LEFT JOIN counts ON counts.doc_id = d.doc_id LEFT JOIN w ON w.term = counts.term AND w.c = cls.c GROUP BY d.doc_id, cls.c, nc, nd)
SELECT a.doc_id, round(1 / (1 + exp(b.j - a.j)), 6) AS y_score FROM jll a JOIN jll b ON a.doc_id = b.doc_id AND a.c = 1 AND b.c = 0"""
_MULTI_W = "w AS (SELECT term, c, ln((n + 1) / (nt + v)) AS w FROM ct JOIN tot USING (c), consts)"
_COMP_W = "w AS (SELECT term, c, -ln((na - n + 1) / (s - nt + v)) AS w FROM ct JOIN tot USING (c) JOIN allt USING (term), consts)"


def _fitted(spark, sf, kind):
    split = docs_split(spark, sf, labelled=True)
    train, rest = split.where(F.col("split") == "train"), split.where(F.col("split") != "train")
    vocabulary = fit_vocabulary(train)
    long = bag_of_words(train, vocabulary, "doc_id", ("label",))
    model = nb.fit_naive_bayes(long, train, "label", kind, vocabulary=vocabulary.table)
    return model, vocabulary, rest


def _scored(spark, sf, kind):
    model, vocabulary, rest = _fitted(spark, sf, kind)
    return nb.score_naive_bayes(model, bag_of_words(rest, vocabulary, "doc_id"), rest, "doc_id", 1).select(
        "doc_id", r6(F.col("y_score"), "y_score"))


@query("naive_bayes_multinomial", _NB + f", {_MULTI_W}, " + _NB_SCORE.format(prior="ln(nc::DOUBLE / nd)"))
def naive_bayes_multinomial(spark, sf):
    return _scored(spark, sf, "multinomial")


@query("naive_bayes_complement", _NB + f", {_COMP_W}, " + _NB_SCORE.format(prior="0"))
def naive_bayes_complement(spark, sf):
    return _scored(spark, sf, "complement")


@query("top_terms", _NB + f""", {_MULTI_W}, r AS (SELECT term, round(max(CASE WHEN c = 1 THEN w END) - max(CASE WHEN c = 0 THEN w END), 9) AS x FROM w GROUP BY term)
  SELECT term, round(x, 6) AS log_ratio, side FROM ((SELECT *, 'positive' AS side FROM r ORDER BY x DESC, term LIMIT 20)
  UNION ALL (SELECT *, 'negative' AS side FROM r ORDER BY x, term LIMIT 20))""")
def top_terms(spark, sf):
    model, vocabulary, _ = _fitted(spark, sf, "multinomial")
    ratios = nb.term_log_ratios(model, 1).withColumn("log_ratio", F.round("log_ratio", 9))
    return nb.top_terms(ratios, vocabulary.table, 20).withColumn("log_ratio", r6(F.col("log_ratio")))


def _features(spark, sf, representation="tfidf"):
    return matrix.build_features(docs_split(spark, sf, labelled=True), representation)


def _quality(features, scores):
    rows = features.docs.where(F.col("split") != "train").select("doc_id", "split", F.col("label").cast("int").alias("y_true")).join(scores, "doc_id")
    return rows.select("doc_id", "split", "y_true", r6(F.col("y_score"), "y_score"))


@query("train_logreg")
def train_logreg(spark, sf):
    f = _features(spark, sf)
    return _quality(f, matrix.score_model(f, "logreg"))


# ---- two features of every document, so that DuckDB can fit the same models: logarithm of the length and share of one letter

_SHAPE = """shape AS (SELECT doc_id, split, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS y, link, date, ln(1 + length(coalesce(text, ''))::DOUBLE) / 4 AS x1,
  10 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE / (1 + length(coalesce(text, ''))) AS x2 FROM split)"""


def _shape(spark, sf):
    size = F.char_length(F.coalesce("text", F.lit("")))
    letters = F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit("")))
    x1, x2 = F.log1p(size.cast("double")) / 4, 10 * (size - letters).cast("double") / (1 + size)
    return docs_split(spark, sf).select("doc_id", "split", "date", "link", F.when(F.col("lang") == "en", 1).otherwise(0).alias("y"),
                                        array_to_vector(F.array(x1, x2)).alias("features"))


def _fitted_weights(solution):
    names = ["w1", "w2", "w0"]
    return {n: float(w) for n, w in zip(names, solution.weights[:, 0])}


@query("train_svc", f"""{WITH_DOCS}, {_SHAPE}, fit AS (SELECT 0 AS grp, * FROM shape WHERE split = 'train'),
{newton_ctes("w", "fit", "squared_hinge")}, {newton_ctes("half", "fit", "squared_hinge", c=0.5)},
two AS (SELECT 1.0 AS c, w.* FROM w UNION ALL SELECT 0.5, half.* FROM half)
SELECT c::DOUBLE AS c, name, round(value, 6) AS value, TRUE AS solved FROM (SELECT c, unnest(['w1', 'w2', 'w0']) AS name, unnest([w1, w2, w0]) AS value FROM two)""")
def train_svc(spark, sf):
    """Weights of the squared-hinge SVM on two features of all documents, for two strengths of the penalty."""
    train = _shape(spark, sf).where("split = 'train'")
    rows = []
    for c in (1.0, 0.5):
        solution = clf.train_svc(train, c=c, tol=1e-8).solution
        rows += [(c, name, round(w, 6), bool(solution.largest_gradient[0] < 1e-4)) for name, w in _fitted_weights(solution).items()]
    return spark.createDataFrame(rows, "c double, name string, value double, solved boolean")


@query("svc_margins")
def svc_margins(spark, sf):
    """Uncalibrated margins of the linear SVM on bags of words."""
    f = _features(spark, sf, "bow")
    docs = f.docs.withColumn("y", F.col("label").cast("double"))
    margins = clf.train_svc(docs.where(F.col("split") == "train")).transform(docs.where(F.col("split") != "train"))
    return _quality(f, margins.select("doc_id", F.col("margin").alias("y_score")))


@query("logreg_weights", f"""{WITH_DOCS}, {_SHAPE}, fit AS (SELECT 0 AS grp, * FROM shape WHERE split = 'train'),
{newton_ctes("w", "fit", "logistic", penalise_intercept=False)}
SELECT doc_id, split, y AS y_true, round(1 / (1 + exp(-(w1 * x1 + w2 * x2 + w0))), 6) AS y_score FROM shape, w WHERE split <> 'train'""")
def logreg_weights(spark, sf):
    """Logistic regression on two features of all documents, solved by the shared solver."""
    rows = _shape(spark, sf)
    train = rows.where("split = 'train'")
    fitted = solve_linear(train, 2, [(1, None)], loss=logistic, penalise_intercept=False, tol=1e-8)
    p = 1.0 / (1.0 + F.exp(-fitted.margins()[0]))
    return rows.where("split <> 'train'").select("doc_id", "split", F.col("y").alias("y_true"), r6(p, "y_score"))


@query("platt_calibrate", f"""{WITH_DOCS}, {_SHAPE}, train AS (SELECT * FROM shape WHERE split = 'train'),
placed AS (SELECT *, floor((row_number() OVER (PARTITION BY y ORDER BY date, link) - 1) * 3 / count(*) OVER (PARTITION BY y))::INTEGER AS fold FROM train),
fit AS (SELECT grp, x1, x2, y FROM placed, (SELECT unnest([0, 1, 2]) AS grp) WHERE fold <> grp),
{newton_ctes("w", "fit", "squared_hinge")},
held AS (SELECT fold AS grp, y, w1 * x1 + w2 * x2 + w0 AS m FROM placed JOIN w ON w.grp = placed.fold),
{sigmoid_ctes("ab", "held")}
SELECT doc_id, split, y AS y_true, round(avg(1 / (1 + exp(-(a * (w1 * x1 + w2 * x2 + w0) + b)))), 6) AS y_score
FROM shape, w JOIN ab USING (grp) WHERE split <> 'train' GROUP BY doc_id, split, y""")
def platt_calibrate(spark, sf):
    """Averaged calibrated scores of three folds, on two features of all documents."""
    rows = _shape(spark, sf)
    model = clf.train_calibrated_svc(rows.where("split = 'train'"), tol=1e-8)
    return model.score(rows.where("split <> 'train'")).select("doc_id", "split", F.col("y").alias("y_true"), r6("y_score"))


@query("calibrated_svc")
def calibrated_svc(spark, sf):
    """Calibrated scores of the linear SVM on TF-IDF."""
    f = _features(spark, sf)
    return _quality(f, matrix.score_model(f, "linearsvc"))


@query("train_gbt")
def train_gbt(spark, sf):
    f = _features(spark, sf, "bow")
    return _quality(f, matrix.score_model(f, "lightgbm"))


@query("multiclass_to_binary")
def multiclass_to_binary(spark, sf):
    f = _features(spark, sf)
    return _quality(f, matrix.score_model(f, "logreg", "multiclass", DOCS_SCHEME, DOCS_POSITIVE))


@query("experiment_matrix")
def experiment_matrix(spark, sf):
    """Two representations, two models, both targets; metrics per run on the test part."""
    runs = []
    for representation in ("tfidf", "bow"):
        runs += matrix.run_matrix(_features(spark, sf, representation), ["multinomialnb", "logreg"],
                                  [("binary", None), ("multiclass", DOCS_SCHEME)], dt.datetime(2026, 1, 5, 9),
                                  positive=DOCS_POSITIVE)
    test = durable(matrix.all_predictions(runs)).where(F.col("split") == "test")
    return ranking.compute_metrics(test, ["run_id"]).select(
        "run_id", *[r6(F.col(c), c) for c in ("pr_auc", "roc_auc", "f1_macro", "f1_minority")])




# ---- the matrix as resumable runs, one query for each representation; the slow cells (README) run through the library only

_TARGETS = (("binary", None), ("multiclass", DOCS_SCHEME))
_BAYES = ("multinomialnb", "complementnb")


def _dictionary(spark, sf):
    vectors = term_vectors(spark, sf)
    return vectors, vectors.count(), 64


def _experiment(spark, sf, representation, models):
    """The report of an experiment that was stopped after its first target and taken up again."""
    split = docs_split(spark, sf, labelled=True)
    features = {}

    def build():
        if representation not in features:
            vectors = _dictionary(spark, sf) if representation == "fasttext" else None
            features[representation] = matrix.build_features(split, representation, vectors=vectors)
        return features[representation]

    ledger = Ledger(spark, new_folder(spark, "ledger"))
    for targets in (_TARGETS[:1], _TARGETS):
        run_experiment(ledger, split, {representation: build}, models, targets, positive=DOCS_POSITIVE)
    return ledger


def _report(ledger):
    summary = reports.run_summary(ledger.runs())
    counted = ledger.predictions().groupBy("run_id").agg(F.count("*").alias("n_predicted"), F.sum("y_true").alias("n_positive"))
    return summary.join(counted, "run_id")


_EXPERIMENT_SQL = f"""{WITH_LABELLED},
sizes AS (SELECT count(*) FILTER (WHERE split = 'test') AS n_test, count(*) FILTER (WHERE split <> 'train') AS n_processed,
  sum(label) FILTER (WHERE split = 'test') AS n_positive FROM split),
classes AS (SELECT count(DISTINCT CASE WHEN category IN ('en', 'fr', 'toxic') THEN category ELSE 'other' END) AS k FROM split WHERE split = 'train'),
cells AS (SELECT unnest([{{models}}]) AS model), targets AS (SELECT unnest(['binary', 'multiclass']) AS target_mode)
SELECT model, '{{representation}}' AS representation, 'raw' AS preprocess, target_mode, CASE WHEN target_mode = 'binary' THEN 2 ELSE k END AS num_classes,
  n_test, n_processed, n_test AS n_predicted, CAST(n_positive AS BIGINT) AS n_positive, TRUE AS scored FROM cells, targets, sizes, classes"""


def _register(representation, models):
    sql = _EXPERIMENT_SQL.format(models=", ".join(f"'{m}'" for m in models), representation=representation)

    @query(f"experiment_{representation}", sql)
    def run(spark, sf):
        found = _report(_experiment(spark, sf, representation, models))
        whole = sum((F.col(m).between(0, 1).cast("int") for m in ("pr_auc", "roc_auc", "f1_macro", "f1_minority")), F.lit(0)) == 4
        return found.select("model", "representation", "preprocess", "target_mode", "num_classes", "n_test", "n_processed", "n_predicted",
                            "n_positive", (whole & (F.col("latency_ms_per_1k") > 0)).alias("scored"))

    run.__doc__ = f"All runs on {representation} features that an interrupted and resumed experiment left behind."
    return run


for _name, _models in (("bow", (*_BAYES, "logreg")), ("tfidf", (*_BAYES, "logreg")), ("fasttext", ("logreg", "linearsvc"))):
    _register(_name, _models)
