"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over hashed lower-case words learns from confirmed toxic documents (P) and unlabelled
text (U) with the class prior p. The negative part of the risk is estimated as
``mean_U loss(-) - p * mean_P loss(-)``, which can't be negative; where the estimate falls below zero the model
has fitted single examples, and the step goes the other way (the non-negative correction).

Weights are shared out by log document frequency and penalised, so words of single documents stay near zero.
The intercept is part of the model; scores are probabilities under the prior.

Edge cases: null and empty texts have no words and get the score of the intercept; labels that are null or
belong to no document teach nothing; a document that is confirmed once counts once; repeated documents are
scored alike, one row each; without any confirmed toxic document every score is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.llm import rolling
from lexsieve.llm.linear import HashedText, Sparse, sigmoid, sparse_batch, sparse_of
from lexsieve.plans.scale import spread

VOCABULARY = HashedText(bits=17, grams=False, words=True, stems=(4, 5), presence=True)
#: Confirmed documents and unlabelled documents that the fit uses at most, chosen by the hash of their id.
POSITIVE_ROWS, UNLABELLED_ROWS = 4_000, 8_000
LEAST_PRIOR = 1e-4


@dataclass
class ToxicModel:
    features: HashedText
    weights: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.features.scores(self.weights, data, offsets) + self.intercept)


def fit_nnpu(positive: Sparse, unlabelled: Sparse, prior: float, *, steps: int = 200, rate: float = 0.1,
             penalty: float = 2e-4, sparsity: float = 8e-3, beta: float = 0.0, least_share: float = 0.002) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam on the non-negative risk with the logistic loss."""
    width = positive.width
    seen = np.bincount(positive.index, minlength=width) + np.bincount(unlabelled.index, minlength=width)
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    sparsity /= np.sqrt(n_p)  # as the noise of a gradient entry
    usable = (seen >= max(3, least_share * (n_p + n_u))).astype(float)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        f_p, f_u = positive.times(w) + b, unlabelled.times(w) + b
        s_p, s_u = sigmoid(f_p), sigmoid(f_u)
        minus = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        up, down_p, down_u = -prior * (1 - s_p) / n_p, -prior * s_p / n_p, s_u / n_u
        if minus < -beta:  # ascend the negative part until the estimate is possible again
            r_p, r_u = -down_p, -down_u
        else:
            r_p, r_u = up + down_p, down_u
        g = (positive.transposed_times(r_p) + unlabelled.transposed_times(r_u)) * usable + penalty * w
        gb = r_p.sum() + r_u.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix_m, fix_v = 1 - 0.9 ** t, 1 - 0.999 ** t
        step = rate * (1 - t / steps) + 1e-3
        scale = step / (np.sqrt(v / fix_v) + 1e-8)
        w -= scale * (m / fix_m)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * sparsity, 0)  # words that say little say nothing
        b -= step * (mb / fix_m) / (np.sqrt(vb / fix_v) + 1e-8)
    return w, b


def train_toxic(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", flag: str = "toxic",
                features: HashedText = VOCABULARY, max_positive: int = POSITIVE_ROWS, max_unlabelled: int = UNLABELLED_ROWS) -> ToxicModel:
    """Fit on confirmed documents and on a bounded sample of all documents as unlabelled text.

    The prior is the share of confirmed documents among the labelled ones. Both samples are chosen by the hash of
    the id; features are made in tasks, and the two bounded matrices are fitted here.
    """
    told = labels.where(F.col(key).isNotNull() & F.col(flag).isNotNull()).groupBy(key).agg(F.max(flag).alias("_flag"))
    share = told.agg(F.avg((F.col("_flag") == 1).cast("double"))).first()[0]
    if not share:
        return ToxicModel(features, np.zeros(features.width), -np.inf)
    order = [F.xxhash64(key), F.col(key)]
    toxic = told.where("_flag = 1").orderBy(*order).limit(max_positive).select(key, F.lit(1).alias("_set"))
    texts = documents.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("_text"))
    plain = texts.select(key).distinct().orderBy(*order).limit(max_unlabelled).select(key, F.lit(0).alias("_set"))
    chosen = toxic.union(plain)  # bounded by the two parameters

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = sparse_batch(features, batch, "_text")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), index, value], ["s", "k", "i", "v"])

    sample = spread(texts, key).join(F.broadcast(chosen), key).select("_set", F.xxhash64(key).alias("_key"), "_text")
    table = sample.mapInArrow(extract, "s int, k long, i binary, v binary").toArrow().sort_by([("k", "ascending"), ("s", "ascending")])
    sets = []
    for kind in (1, 0):
        own = table.filter(pc.equal(table["s"], kind))
        sets.append(sparse_of(own["i"], own["v"], features.width))
    del table, own
    weights, intercept = fit_nnpu(*sets, min(max(share, LEAST_PRIOR), 1 - LEAST_PRIOR))
    return ToxicModel(features, weights, intercept)


def score_toxic(documents: DataFrame, model: ToxicModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(data, offsets))], ["doc_id", "score"])

    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return spread(texts, "doc_id").mapInArrow(score, "doc_id long, score double")


def held_out(key: str, folds: int = 5) -> Column:
    """Fold 0 of the crc32 of the id as text; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))
