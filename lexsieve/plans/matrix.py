"""The experiment matrix: one representation shared by several models, binary or multiclass."""

from __future__ import annotations

import datetime as dt
import functools
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.functions import fixed
from lexsieve.functions.labels import (class_code, collapse_category, encode_classes, resolve_scheme,
                                       run_name, variant_name, variant_tag)
from lexsieve.operators import classifiers as clf
from lexsieve.operators.cleaning import clean_aggressive
from lexsieve.operators.features import bag_of_words, embedding_average, hashed_terms, sparse_vectors, tfidf
from lexsieve.operators.naive_bayes import fit_naive_bayes, score_naive_bayes
from lexsieve.operators.threshold import ThresholdDecision, decide, fit_threshold
from lexsieve.operators.vocabulary import fit_vocabulary
from lexsieve.plans.scale import written

@dataclass(frozen=True)
class Features:
    """What every model of one representation reads, computed once.

    ``docs`` has one row per document (id, split, label, category, date, link, vector); ``long`` the
    term table that naive Bayes and hashing use (None for embeddings); ``cleaning`` what was done to the
    texts before.
    """

    representation: str
    docs: DataFrame
    long: DataFrame | None
    vocabulary: object | None
    doc_id: str
    cleaning: str = "raw"


@dataclass(frozen=True)
class Run:
    run_id: str
    model: str
    mode: str
    decision: ThresholdDecision
    predictions: DataFrame  # run_id, split, doc_id, y_true, y_pred, y_score over val and test


def check_models(representation: str, models: list[str], mode: str, scheme) -> None:
    if representation not in fixed.REPRESENTATIONS:
        raise ValueError(f"representation must be one of {fixed.REPRESENTATIONS}, got {representation!r}")
    if mode not in fixed.TARGET_MODES:
        raise ValueError(f"target mode must be one of {fixed.TARGET_MODES}, got {mode!r}")
    unknown = [m for m in models if m not in fixed.CLASSIFIERS]
    if unknown:
        raise ValueError(f"unknown models {unknown}, use {fixed.CLASSIFIERS}")
    if representation == "fasttext":
        bad = [m for m in models if m in fixed.NON_NEGATIVE_CLASSIFIERS]
        if bad:
            raise ValueError(f"embeddings can be negative, which {bad} cannot take")
    if mode == "binary" and scheme is not None:
        raise ValueError("a collapse scheme belongs to the multiclass mode")
    if mode == "multiclass" and scheme is None:
        raise ValueError("the multiclass mode needs a collapse scheme")


def build_features(split: DataFrame, representation: str, doc_id: str = "doc_id", text: str = "text",
                   ngram_range: tuple[int, int] | None = None, min_df: int = fixed.MIN_DF,
                   max_df: float = fixed.MAX_DF, vectors: tuple[DataFrame, int, int] | None = None,
                   dictionary: tuple[DataFrame, int] | None = None) -> Features:
    """Clean, fit on train, transform everything, and write the result once for all models.

    ``dictionary`` (token table, counted rows) asks for aggressive cleaning; ``vectors`` is (dictionary,
    counted rows, dimension) for embeddings.
    """
    attributes = [doc_id, "split", "label", "category", "date", "link"]
    docs = split.select(*attributes)
    cleaning = "raw" if dictionary is None else "aggressive"
    if dictionary is not None:
        cleaned = clean_aggressive(split, *dictionary, doc_id, text)
        split = written(docs.join(cleaned.select(doc_id, F.col("text").alias(text)), doc_id), "cleaned")
    if representation == "fasttext":
        if vectors is None:
            raise ValueError("embeddings need a dictionary")
        means = embedding_average(split, *vectors, doc_id, text)
        table = docs.join(means.select(doc_id, array_to_vector("vector").alias("features")), doc_id)
        return Features(representation, written(table, "features"), None, None, doc_id, cleaning)
    grams = ngram_range or (fixed.TFIDF_NGRAMS if representation == "tfidf" else fixed.BOW_NGRAMS)
    vocabulary = fit_vocabulary(split.where(F.col("split") == "train"), text, grams, min_df, max_df)
    build = tfidf if representation == "tfidf" else bag_of_words
    long = written(build(split, vocabulary, doc_id, ("split", "label", "category"), text), "terms")
    table = written(sparse_vectors(docs, long, vocabulary.n_terms, doc_id), "features")
    return Features(representation, table, long, vocabulary, doc_id, cleaning)


def _target(mode: str, scheme, positive: str, train: DataFrame):
    """Column giving the class code, the number of observed classes, the positive code, the encoding."""
    if mode == "binary":
        return F.col("label").cast("int"), 2, 1, None
    spec = resolve_scheme(scheme, positive)
    collapsed = collapse_category("category", spec["keep"], spec["sink"])
    encoding = encode_classes(train.select(collapsed.alias("c")), "c", positive)
    return class_code(collapsed, encoding), len(encoding), encoding[positive], encoding


def score_model(features: Features, model: str, mode: str = "binary", scheme=None,
                positive: str = fixed.POSITIVE_CATEGORY, trees: int = 100, tree_columns: int | None = None) -> DataFrame:
    """(doc_id, y_score) over val and test for one model fitted on train.

    ``tree_columns`` asks for terms hashed into that many columns for the trees; None takes every term.
    """
    check_models(features.representation, [model], mode, scheme)
    key = features.doc_id
    target, classes, code, _ = _target(mode, scheme, positive, features.docs.where(F.col("split") == "train"))
    docs = features.docs.withColumn("y", target)
    train, rest = docs.where(F.col("split") == "train"), docs.where(F.col("split") != "train")
    if model in fixed.NON_NEGATIVE_CLASSIFIERS:
        long = features.long.withColumn("y", target)
        fitted = fit_naive_bayes(long.where(F.col("split") == "train"), train.select("y"), "y",
                                 model.removesuffix("nb"), vocabulary=features.vocabulary.table)
        return score_naive_bayes(fitted, long.where(F.col("split") != "train").select(key, "term_id", "value"),
                                 rest, key, code)
    if model == "lightgbm" and features.long is not None and tree_columns is not None:
        folded = hashed_terms(features.long, key, tree_columns)
        docs = written(sparse_vectors(docs.drop("features"), folded, tree_columns, key, "slot"), "hashed")
        train, rest = docs.where(F.col("split") == "train"), docs.where(F.col("split") != "train")
    if model == "logreg":
        fitted = clf.train_logreg(train, code)
    elif model == "linearsvc":
        fitted = clf.train_calibrated_svc(train, classes, code)
    else:
        fitted = clf.train_boosted_trees(train, classes, code, trees=trees)
    return fitted.score(rest.select(key, "features")).select(key, "y_score")


def run_matrix(features: Features, models: list[str], modes: list[tuple[str, object]], started: dt.datetime,
               positive: str = fixed.POSITIVE_CATEGORY, trees: int = 100, tree_columns: int | None = None) -> list[Run]:
    """Fit, score, calibrate and decide every (model, mode); features are read, never rebuilt.

    The loop runs over models, a handful; each score table is written once because the threshold, the
    metrics and the reports all read it.
    """
    for mode, scheme in modes:
        check_models(features.representation, models, mode, scheme)
    truth = features.docs.select(features.doc_id, "split", F.col("label").cast("int").alias("y_true"))
    runs = []
    for mode, scheme in modes:
        variant = variant_name(features.representation, features.cleaning, variant_tag(mode, scheme))
        for model in models:
            scores = score_model(features, model, mode, scheme, positive, trees, tree_columns)
            scored = written(truth.where(F.col("split") != "train").join(scores, features.doc_id), "scores")
            decision = fit_threshold(scored.where(F.col("split") == "val"))
            run_id = run_name("gen1", model, variant, started)
            runs.append(Run(run_id, model, mode, decision, scored.select(
                F.lit(run_id).alias("run_id"), "split", features.doc_id, "y_true",
                decide("y_score", decision).alias("y_pred"), "y_score")))
    return runs


def all_predictions(runs: list[Run]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [r.predictions for r in runs])
