"""Linear classifiers on vectors by the shared solver and boosted trees, scored as P(positive)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.operators.boosted_trees import Boosted, boost
from lexsieve.operators.linear_solver import Solution, logistic, row_margins, softmax, solve_linear, sparse_rows
from lexsieve.plans.scale import global_index, local_table, written


@dataclass(frozen=True)
class LogisticWeights:
    """Weights with the intercept last: one column for two classes, else one for each class."""

    weights: np.ndarray

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.weights[:-1, 0])

    @property
    def intercept(self) -> float:
        return float(self.weights[-1, 0])


@dataclass(frozen=True)
class LinearModel:
    model: LogisticWeights
    code: int

    def score(self, rows: DataFrame) -> DataFrame:
        weights, code = self.model.weights, self.code

        @F.arrow_udf("double")
        def score_(vectors: pa.Array) -> pa.Array:
            m = np.clip(row_margins(*sparse_rows(vectors), weights), -1e300, 1e300)  # one class only: infinite
            if m.shape[1] == 1:
                return pa.array(np.exp(-np.logaddexp(0.0, -m[:, 0] if code else m[:, 0])))
            p = np.exp(m - m.max(axis=1, keepdims=True))
            return pa.array(p[:, code] / p.sum(axis=1))

        return rows.withColumn("y_score", score_("features"))


def train_logreg(train: DataFrame, code: int = 1, label: str = "y", c: float = 1.0,
                 max_iter: int = 2000, tol: float = 1e-4) -> LinearModel:
    """L2 logistic regression, penalty 1/(2C) on the sum of losses, intercepts free; softmax beyond two classes.

    ``max_iter`` bounds the scans, ``tol`` the largest component of the gradient of C times the sum of losses. Rows of one class
    only have zero weights and an infinite intercept.
    """
    y = F.col(label).cast("double")
    seen = train.agg(F.min(y).alias("low"), F.max(y).alias("high"), F.count_if(y.isNull() | (y != F.floor(y))).alias("bad")).first()
    if seen["low"] is None or seen["bad"] or seen["low"] < 0:
        raise ValueError("no rows to fit on, or labels that are no class codes")
    size, classes = width_of(train), int(seen["high"]) + 1
    if seen["low"] == seen["high"]:
        weights = np.zeros((size + 1, 1 if classes <= 2 else classes))
        weights[-1, -1] = np.inf if classes > 1 else -np.inf
        return LinearModel(LogisticWeights(weights), code)
    problems, loss = ([(1, None)], logistic) if classes == 2 else ([(k, None) for k in range(classes)], softmax)
    found = solve_linear(train, size, problems, label=label, loss=loss, c=c, penalise_intercept=False, tol=tol, max_scans=max_iter)
    return LinearModel(LogisticWeights(found.weights), code)


def width_of(rows: DataFrame, features: str = "features") -> int:
    """Length of the feature vectors, from one row."""
    row = rows.select(features).first()
    if row is None:
        raise ValueError("no rows to fit on")
    return len(row[0])


@dataclass(frozen=True)
class LinearSvc:
    """Weights with the intercept last; margins still need calibration."""

    solution: Solution

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("margin", self.solution.margins()[0])


def train_svc(train: DataFrame, label: str = "y", c: float = 1.0, tol: float = 1e-4, max_scans: int = 1000) -> LinearSvc:
    """Linear SVM with squared hinge loss, the intercept penalised like a weight of a constant feature."""
    return LinearSvc(solve_linear(train, width_of(train), [(1, None)], label=label, c=c, tol=tol, max_scans=max_scans))


def assign_folds(train: DataFrame, label: str, order: tuple[str, ...], folds: int = 3) -> DataFrame:
    """Contiguous folds within each class in the given order, sizes equal to within one row.

    Only the label and the order are numbered (a class may hold most of the rows); the first rows of the folds, at most
    ``folds`` for each class, come back as bounds that every row is compared with. Rows equal in all of ``order`` share a fold.
    """
    numbered = global_index(train.select(label, *order), [label, *order], "_row")
    spans = numbered.groupBy(label).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
    placed = numbered.join(F.broadcast(spans), label)  # one row per class

    def fold_at(position: Column) -> Column:
        return F.floor(position * folds / F.col("_size"))

    position = F.col("_row") - F.col("_first")
    bounds = placed.where((position > 0) & (fold_at(position) > fold_at(position - 1))).groupBy(label).agg(
        F.collect_list(F.struct(*order, (fold_at(position) - fold_at(position - 1)).alias("_by"))).alias("_bounds"))
    own = F.struct(*order)
    passed = F.filter(F.coalesce("_bounds", F.array()), lambda b: F.struct(*[b[c] for c in order]) <= own)
    return train.join(F.broadcast(bounds), label, "left").withColumn(
        "fold", F.aggregate(passed, F.lit(0).cast("long"), lambda n, b: n + b["_by"]).cast("int")).drop("_bounds")


@dataclass(frozen=True)
class CalibratedSvc:
    """Averaged sigmoid-calibrated margins: a problem for each class and fold, its slope and its intercept."""

    solution: Solution
    sigmoids: np.ndarray  # (problems, 2), classes outside and folds inside
    classes: tuple[int, ...]
    folds: int
    code: int = 1

    def score(self, rows: DataFrame) -> DataFrame:
        weights, (slope, shift) = self.solution.weights, self.sigmoids.T
        n, folds, wanted = len(self.classes), self.folds, self.classes.index(self.code)

        @F.arrow_udf("double")
        def score_(vectors: pa.Array) -> pa.Array:
            z = row_margins(*sparse_rows(vectors), weights) * slope + shift
            p = np.exp(-np.logaddexp(0.0, -z)).reshape(-1, n, folds)
            if n > 1:  # one-vs-rest: each fold normalizes its own class probabilities before averaging
                mass = p.sum(axis=1, keepdims=True)
                p = np.divide(p, mass, out=np.full_like(p, 1.0 / n), where=mass > 0)
            return pa.array(p[:, wanted].mean(axis=1))

        return rows.withColumn("y_score", score_("features"))


def fit_sigmoids(margins: DataFrame, by: list[str], label: str = "y", margin: str = "margin", max_scans: int = 200) -> dict[tuple, tuple[float, float]]:
    """Slope and intercept of Platt scaling with smoothed targets for every group of ``by``, all from the same scans.

    Newton steps with halving; a scan adds up the loss, gradient and curvature of all groups at their trial points. Groups
    are a report dimension (classes x folds), one row of sums each.
    """
    sizes = margins.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")).collect()
    spark = margins.sparkSession
    state = {tuple(r[c] for c in by): _Sigmoid(r["_p"], r["_n"]) for r in sizes}
    for _ in range(max_scans):
        open_ = {k: s for k, s in state.items() if not s.done}
        if not open_:
            break
        keys = list(open_)
        trial = local_table(spark, **{c: [k[i] for k in keys] for i, c in enumerate(by)}, _high=[open_[k].high for k in keys], _low=[open_[k].low for k in keys],
                            _a=[open_[k].trial[0] for k in keys], _b=[open_[k].trial[1] for k in keys])
        m, target = F.col(margin), F.when(F.col(label) == 1, F.col("_high")).otherwise(F.col("_low"))
        z = F.col("_a") * m + F.col("_b")
        p = 1.0 / (1.0 + F.exp(-z))
        sums = margins.join(F.broadcast(trial), by).select(*by, m.alias("m"), (p - target).alias("d"), (p * (1.0 - p)).alias("h"),
                                                         (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z).alias("f"))
        found = sums.groupBy(*by).agg(F.sum("f").alias("f"), F.sum(F.col("d") * F.col("m")).alias("ga"), F.sum("d").alias("gb"),
                                      F.sum(F.col("h") * F.col("m") * F.col("m")).alias("haa"), F.sum(F.col("h") * F.col("m")).alias("hab"), F.sum("h").alias("hbb"))
        for r in found.collect():
            open_[tuple(r[c] for c in by)].saw(r["f"], np.array([r["ga"], r["gb"]]), np.array([[r["haa"], r["hab"]], [r["hab"], r["hbb"]]]))
    return {k: (float(s.at[0]), float(s.at[1])) for k, s in state.items()}


class _Sigmoid:
    """Newton state of one group; p and n are its positive and negative rows."""

    def __init__(self, p: int, n: int) -> None:
        self.high, self.low = (p + 1.0) / (p + 2.0), 1.0 / (n + 2.0)
        self.at = np.array([0.0, np.log((p + 1.0) / (n + 1.0))])
        self.value, self.step, self.way, self.slope, self.done = np.inf, 1.0, np.zeros(2), 0.0, p + n == 0

    @property
    def trial(self) -> np.ndarray:
        return self.at + self.step * self.way

    def saw(self, value: float, gradient: np.ndarray, curve: np.ndarray) -> None:
        if value > self.value + 1e-4 * self.step * self.slope + 1e-12 * abs(self.value):
            self.step /= 2
            self.done = self.step < 1e-10
            return
        self.at, self.value, self.step = self.trial, value, 1.0
        self.way = -np.linalg.solve(curve + 1e-12 * np.eye(2), gradient)
        self.slope = float(gradient @ self.way)
        self.done = np.abs(gradient).max() < 1e-9 * max(1.0, abs(value)) or np.abs(self.way).max() < 1e-12 * max(1.0, np.abs(self.at).max())


def fit_sigmoid(margins: DataFrame, label: str = "y", margin: str = "margin") -> tuple[float, float]:
    """Slope and intercept of Platt scaling of one column of margins."""
    found = fit_sigmoids(margins.withColumn("_all", F.lit(0)), ["_all"], label, margin)
    if not found:
        raise ValueError("no margins to calibrate")
    return found[0,]


def train_calibrated_svc(train: DataFrame, classes: int = 2, code: int = 1, label: str = "y", order: tuple[str, ...] = ("date", "link"),
                         c: float = 1.0, folds: int = 3, tol: float = 1e-4, max_scans: int = 1000) -> CalibratedSvc:
    """Linear SVM per class and fold, calibrated on the fold left out; one-vs-rest beyond two classes.

    All SVMs share their scans, and all sigmoids theirs.
    """
    folded = assign_folds(train, label, order, folds)
    targets = [code] if classes == 2 else list(range(classes))
    jobs = [(cls, f) for cls in targets for f in range(folds)]
    solution = solve_linear(folded, width_of(train), jobs, label=label, fold="fold", c=c, tol=tol, max_scans=max_scans)
    held = written(folded.select(F.col(label).alias("_label"), "fold", solution.margins().alias("_m")).select(
        "_label", "fold", F.posexplode("_m").alias("problem", "margin")).where(F.col("problem") % folds == F.col("fold")).select(
        F.col("problem").cast("long"), (F.element_at(F.array(*map(F.lit, targets)), F.floor(F.col("problem") / folds).cast("int") + 1) == F.col("_label")).cast("int").alias("y"), "margin"), "margins")
    found = fit_sigmoids(held, ["problem"])
    # a fold without rows (fewer rows than folds) has no margins: its sigmoid stays at even odds
    sigmoids = np.array([found.get((k,), (0.0, 0.0)) for k in range(len(jobs))])
    return CalibratedSvc(solution, sigmoids, tuple(targets), folds, code)


@dataclass(frozen=True)
class BoostedTrees:
    members: dict[int, Boosted]
    code: int

    def score(self, rows: DataFrame) -> DataFrame:
        members, wanted = list(self.members.values()), list(self.members).index(self.code)

        @F.arrow_udf("double")
        def score_(vectors: pa.Array) -> pa.Array:
            found = sparse_rows(vectors)
            size = int(found[1].max(initial=-1)) + 1
            size = max([size, *(int(t.feature.max()) + 1 for m in members for t in m.trees)])
            p = np.stack([m.probabilities(*found, size) for m in members], axis=1)
            if len(members) > 1:
                mass = p.sum(axis=1, keepdims=True)
                p = np.divide(p, mass, out=np.full_like(p, 1.0 / len(members)), where=mass > 0)
            return pa.array(p[:, wanted])

        return rows.withColumn("y_score", score_("features"))


def train_boosted_trees(train: DataFrame, classes: int = 2, code: int = 1, label: str = "y",
                        trees: int = 100, depth: int = 5, step: float = 0.1) -> BoostedTrees:
    """Gradient-boosted trees; one-vs-rest beyond two classes."""
    wanted = [code] if classes == 2 else list(range(classes))
    return BoostedTrees(boost(train, wanted, width_of(train), label, trees, depth, step), code)


def softmax_positive(logits: Column | str, code: int) -> Column:
    """Softmax of an array of logits, component ``code``."""
    logits = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(logits)
    mass = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
    return F.exp(logits[code].cast("double") - top) / mass
