"""Multinomial and complement naive Bayes, exact, fitted and scored as joins and sums."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.plans.scale import durable, lookup

KINDS = ("multinomial", "complement")


@dataclass(frozen=True)
class NaiveBayes:
    """Term weights (term_id, w array by class position) and class offsets."""

    kind: str
    classes: tuple
    weights: DataFrame
    offsets: tuple[float, ...]
    n_terms: int
    total_weight: int


def fit_naive_bayes(long: DataFrame, docs: DataFrame, label: str, kind: str = "multinomial",
                    alpha: float = 1.0, vocabulary: DataFrame | None = None,
                    max_classes: int = 1000) -> NaiveBayes:
    """Fit from the long features of the training documents.

    ``long`` carries ``label`` with (term_id, value); ``docs`` gives the class sizes. Terms of
    ``vocabulary`` without a training occurrence still count for the smoothing.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    sizes = {r[0]: r[1] for r in docs.groupBy(label).agg(F.count(F.lit(1))).limit(max_classes + 1).collect()}
    if len(sizes) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes")
    classes = tuple(sorted(sizes))
    per_class = [F.sum(F.when(F.col(label) == c, F.col("value")).otherwise(0.0)).alias(f"c{i}")
                 for i, c in enumerate(classes)]
    table = long.groupBy("term_id").agg(*per_class, F.count(F.lit(1)).alias("weight"))
    cols = [f"c{i}" for i in range(len(classes))]
    if vocabulary is not None:
        table = vocabulary.select("term_id").join(table, "term_id", "left").na.fill(0.0, cols).na.fill(0, ["weight"])
    table = durable(table)
    row = table.agg(F.count(F.lit(1)).alias("v"), F.sum("weight").alias("w"), *[F.sum(c).alias(c) for c in cols]).first()
    v, totals = row["v"], [row[c] or 0.0 for c in cols]
    n_all = sum(totals)
    everything = sum((F.col(c) for c in cols), F.lit(0.0))
    if kind == "multinomial":
        weights = [F.log((F.col(c) + alpha) / (t + alpha * v)) for c, t in zip(cols, totals)]
        n = sum(sizes.values())
        offsets = tuple(math.log(sizes[c] / n) for c in classes)
    else:
        weights = [-F.log((everything - F.col(c) + alpha) / (n_all - t + alpha * v))
                   for c, t in zip(cols, totals)]
        offsets = (0.0,) * len(classes)
    return NaiveBayes(kind, classes, table.select("term_id", F.array(*weights).alias("w"), "weight"),
                      offsets, v, row["w"] or 0)


def score_naive_bayes(model: NaiveBayes, long: DataFrame, docs: DataFrame, doc_id: str, positive,
                      broadcast_bytes: int | None = None) -> DataFrame:
    """(doc_id, y_score): probability of ``positive`` for every document of ``docs``."""
    if positive not in model.classes:
        raise ValueError(f"positive class {positive!r} is not among {model.classes!r}")
    k = len(model.classes)
    joined = lookup(long, model.weights, "term_id", table_rows=model.n_terms, row_bytes=64 + 8 * k,
                    salt_on=doc_id, weight="weight", weight_total=max(model.total_weight, 1),
                    how="inner", broadcast_bytes=broadcast_bytes)
    sums = joined.groupBy(doc_id).agg(
        *[F.sum(F.col("value") * F.col("w")[i]).alias(f"s{i}") for i in range(k)])
    totals = [F.coalesce(f"s{i}", F.lit(0.0)) + o for i, o in enumerate(model.offsets)]
    # a document may have no known term: the offsets alone decide
    scored = docs.select(doc_id).join(sums, doc_id, "left").select(doc_id, *[t.alias(f"t{i}") for i, t in enumerate(totals)])
    names = [F.col(f"t{i}") for i in range(k)]
    top = F.greatest(*names) if k > 1 else names[0]
    mass = sum((F.exp(t - top) for t in names), F.lit(0.0))
    return scored.select(doc_id, (F.exp(names[model.classes.index(positive)] - top) / mass).alias("y_score"))


def term_log_ratios(model: NaiveBayes, positive) -> DataFrame:
    """(term_id, log_ratio): weight of the positive class minus the mean weight of the others."""
    p = model.classes.index(positive)
    others = [F.col("w")[i] for i in range(len(model.classes)) if i != p]
    return model.weights.select("term_id", (F.col("w")[p] - sum(others[1:], others[0]) / len(others)).alias("log_ratio"))


def top_terms(ratios: DataFrame, vocabulary: DataFrame, k: int = 20, weight: str = "log_ratio") -> DataFrame:
    """The k heaviest terms of each side; equal weights follow the alphabet, which is the id order."""
    up = ratios.orderBy(F.desc(weight), "term_id").limit(k).withColumn("side", F.lit("positive"))
    down = ratios.orderBy(F.asc(weight), "term_id").limit(k).withColumn("side", F.lit("negative"))
    best = F.broadcast(up.unionByName(down))  # 2k rows
    return vocabulary.select("term_id", "term").join(best, "term_id").drop("term_id")
