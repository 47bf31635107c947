"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text and ordered thresholds t_1 < ... < t_(K-1) model
``P(grade >= k) = sigmoid(w.x - t_k)``. The expected grade is the sum of these tails; selection keeps
documents whose tail probability at a chosen grade reaches a cut.

Edge cases: null and empty texts have no features and get the score of the thresholds alone; ratings that
are null or belong to no document are not trained on; a document rated twice counts with its lowest rating;
repeated documents are scored alike, one row each; with fewer than two distinct grades every document gets
tail 1 at or below the only grade. Extra columns of `documents` are passed through untouched; clashing
names raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsieve.llm import rolling
from lexsieve.llm.linear import HashedText, Sparse, minimise, release_unused, sigmoid, sparse_batch, sparse_of
from lexsieve.plans.scale import spread

STYLE = HashedText(bits=15, grams=True, echoes=True)
#: Labelled rows that the fit uses at most, chosen by the hash of their id.
TRAIN_ROWS = 8_000
SCALE = 30.0


@dataclass
class OrdinalModel:
    features: HashedText
    grades: list[float]
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1.. of each document."""
        score = self.features.scores(self.weights, data, offsets)
        return sigmoid(score[:, None] - self.cuts[None, :])


def fit_ordinal(x: Sparse, y: np.ndarray, classes: int, penalty: float = 1e-4, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that minimise the penalised mean log loss. y: class numbers from 0."""
    n, gaps = len(x), classes - 2

    def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p[:x.width], np.cumsum(np.concatenate((p[x.width:x.width + 1], np.exp(p[x.width + 1:]))))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, cuts = unpack(p)
        z = SCALE * x.times(w)
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        upper, lower = sigmoid(edge[y + 1] - z), sigmoid(edge[y] - z)
        like = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / like, lower * (1 - lower) / like
        d_cut = np.zeros(classes + 1)
        np.add.at(d_cut, y + 1, -d_upper)
        np.add.at(d_cut, y, d_lower)
        d_cut = d_cut[1:classes] / n
        tail = np.cumsum(d_cut[::-1])[::-1]
        d_p = np.concatenate((SCALE * x.transposed_times((d_upper - d_lower) / n) + 2 * penalty * w,
                              tail[:1], tail[1:] * np.exp(p[x.width + 1:])))
        return float(-np.log(like).mean() + penalty * (w @ w)), d_p

    share = np.clip(np.cumsum(np.bincount(y, minlength=classes))[:-1] / n, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    start = np.concatenate((np.zeros(x.width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))[:gaps]))
    w, cuts = unpack(minimise(loss, start, steps))
    return SCALE * w, cuts


def train_ordinal(documents: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text", grade: str = "grade",
                  features: HashedText = STYLE, max_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most `max_rows` rated documents; features are made in tasks, the small matrix is fitted here."""
    rated = ratings.where(F.col(key).isNotNull() & F.col(grade).isNotNull()).groupBy(key).agg(
        F.min(grade).cast("double").alias("_grade"))
    chosen = rated.orderBy(F.xxhash64(key), key).limit(max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = sparse_batch(features, batch, "_text")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), index, value], ["g", "k", "i", "v"])

    texts = documents.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("_text"))
    sample = spread(texts, key).join(F.broadcast(chosen), key).select("_grade", F.xxhash64(key).alias("_key"), "_text")
    table = sample.mapInArrow(extract, "g double, k long, i binary, v binary").toArrow()
    order = np.lexsort((table["g"].to_numpy(), table["k"].to_numpy()))
    x, given = sparse_of(table["i"], table["v"], features.width, order), table["g"].to_numpy()[order]
    del table
    release_unused()
    grades, y = np.unique(given, return_inverse=True)
    if len(grades) < 2:
        return OrdinalModel(features, grades.tolist() or [0.0], np.zeros(features.width), np.zeros(0))
    weights, cuts = fit_ordinal(x, y, len(grades))
    del x
    release_unused()
    return OrdinalModel(features, grades.tolist(), weights, cuts)


def score_ordinal(documents: DataFrame, model: OrdinalModel, keep_from: float, *, text: str = "text") -> DataFrame:
    """`documents` with expected_grade and tail_probability = P(grade >= keep_from)."""
    added = ["expected_grade", "tail_probability"]
    if clash := set(added) & set(documents.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    grades = np.array(model.grades)
    at = int(np.searchsorted(grades, keep_from)) - 1
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, text):
                tails = own.tails(data, offsets)
                expected = grades[0] + tails @ np.diff(grades)
                chosen = tails[:, at] if 0 <= at < tails.shape[1] else np.full(len(tails), float(at < 0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(expected), pa.array(chosen)],
                                                 [*part.schema.names, *added])

    schema = T.StructType([*documents.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added)])
    return documents.mapInArrow(score, schema)


def select_quality(documents: DataFrame, model: OrdinalModel, keep_from: float, cut: float = 0.5, *, text: str = "text") -> DataFrame:
    """The documents whose tail probability at `keep_from` is at least `cut`, with their own columns."""
    return score_ordinal(documents, model, keep_from, text=text).where(F.col("tail_probability") >= cut).select(*documents.columns)
