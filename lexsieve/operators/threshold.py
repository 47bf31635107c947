"""Threshold fitted on validation scores, frozen, then applied.

One pass over the scores: each falls into the bucket of the highest grid point at or below it,
positives and negatives are counted per bucket (92 at most), and the whole sweep is computed from
those counters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.functions import fixed
from lexsieve.operators.decision import f1_macro, f1_positive, not_binary, unless_bad
from lexsieve.plans.scale import local_table

MAX_RUNS = 10_000
GRID = tuple(i / 100 for i in range(fixed.GRID_FIRST, fixed.GRID_LAST + 1))


@dataclass(frozen=True)
class ThresholdDecision:
    value: float
    objective: str
    fitted_on: str = "val"
    grid: tuple[float, ...] = field(default=GRID)


def _check_objective(objective: str) -> None:
    if objective not in fixed.THRESHOLD_OBJECTIVES:
        raise ValueError(f"objective must be one of {fixed.THRESHOLD_OBJECTIVES}, got {objective!r}")


def _step(score: Column) -> Column:
    """Hundredths of the highest grid point <= score, GRID_FIRST - 1 below the grid.

    floor(score * 100) can be one off; comparing with the grid value itself settles it.
    """
    k = F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 100).cast("int")
    k = F.when((k + 1) / F.lit(100.0) <= score, k + 1).when(k / F.lit(100.0) > score, k - 1).otherwise(k)
    inside = F.least(F.greatest(k, F.lit(fixed.GRID_FIRST - 1)), F.lit(fixed.GRID_LAST))
    return F.when(F.isnan(score), F.lit(fixed.GRID_FIRST - 1)).otherwise(inside)


def threshold_sweep(val: DataFrame, by: list[str], y_true: str = "y_true", y_score: str = "y_score") -> DataFrame:
    """Confusion cells and both F1 objectives at every grid point, per group of ``by``."""
    y, s = F.col(y_true), F.col(y_score).cast("double")
    steps = val.groupBy(*by, _step(s).alias("k")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), F.count_if(not_binary(y)).alias("bad"))
    # per group: at most 92 counters, then 91 grid points from them
    counters = steps.groupBy(*by).agg(
        F.collect_list(F.struct("k", "pos", "neg")).alias("c"),
        unless_bad(F.sum("bad"), F.sum("pos"), "labels").alias("p"), F.sum("neg").alias("n"))
    grid = counters.withColumn("g", F.explode(F.sequence(F.lit(fixed.GRID_FIRST), F.lit(fixed.GRID_LAST))))

    def above(name: str) -> Column:
        return F.aggregate("c", F.lit(0).cast("bigint"),
                           lambda acc, x: acc + F.when(x["k"] >= F.col("g"), x[name]).otherwise(0))

    cells = grid.select(*by, (F.col("g") / F.lit(100.0)).alias("threshold"), above("pos").alias("tp"),
                        above("neg").alias("fp"), "p", "n")
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("p") - tp, F.col("n") - fp
    return cells.select(*by, "threshold", "tp", "fp", fn.alias("fn"), tn.alias("tn"),
                        f1_positive(tp, fp, fn).alias("f1_minority"),
                        f1_macro(tn, fp, fn, tp).alias("f1_macro"))


def best_thresholds(val: DataFrame, by: list[str], objectives: tuple[str, ...] = fixed.THRESHOLD_OBJECTIVES,
                    y_true: str = "y_true", y_score: str = "y_score") -> DataFrame:
    """For each objective a struct (value, threshold) per group, all from one sweep; among equals the smallest cut."""
    for objective in objectives:
        _check_objective(objective)
    best = threshold_sweep(val, by, y_true, y_score).groupBy(*by).agg(
        *[F.max(F.struct(o, (-F.col("threshold")).alias("back"))).alias(o) for o in objectives])
    return best.select(*by, *[F.struct(F.col(f"{o}.{o}").alias("value"), (-F.col(f"{o}.back")).alias("threshold")).alias(o) for o in objectives])


def fit_thresholds(val: DataFrame, by: list[str], objective: str = "f1_minority",
                   y_true: str = "y_true", y_score: str = "y_score") -> DataFrame:
    """Best grid point per group; among equals the smallest."""
    best = best_thresholds(val, by, (objective,), y_true, y_score)
    return best.select(*by, f"{objective}.threshold", f"{objective}.value").toDF(*by, "threshold", "objective_value")


def fit_threshold(val: DataFrame, objective: str = "f1_minority", y_true: str = "y_true",
                  y_score: str = "y_score") -> ThresholdDecision:
    """Frozen decision of one run; there is no way to refit it on test."""
    _check_objective(objective)
    checks = val.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(y_true).isNull() | ~F.col(y_true).isin(0, 1)).alias("bad"),
        F.count_if(F.col(y_score).isNull()).alias("unscored"),
        F.count_if(F.col(y_true) == 1).alias("pos")).first()
    if checks["n"] == 0:
        raise ValueError("no validation rows")
    if checks["bad"] or checks["unscored"]:
        raise ValueError(f"{checks['bad']} labels outside 0/1 and {checks['unscored']} rows without a score")
    if checks["pos"] in (0, checks["n"]):
        raise ValueError("validation labels hold a single class")
    row = fit_thresholds(val, [], objective, y_true, y_score).first()
    return ThresholdDecision(float(row["threshold"]), objective)


def decide(score: Column | str, cut: Column | float | ThresholdDecision) -> Column:
    """1 where score >= cut; a score that is not a number decides 0."""
    score = F.col(score) if isinstance(score, str) else score
    if isinstance(cut, ThresholdDecision):
        cut = cut.value
    cut = cut if isinstance(cut, Column) else F.lit(float(cut))
    return ((score >= cut) & ~F.isnan(score)).cast("int")


def frozen(cuts: DataFrame, by: list[str]) -> DataFrame:
    """The fitted cuts as literal rows: fitted once, never re-evaluated by a later plan.

    One row per run, so their number is checked against MAX_RUNS and not against the data.
    """
    rows = cuts.select(*by, "threshold").limit(MAX_RUNS + 1).collect()
    if len(rows) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} groups have a threshold of their own")
    if not rows:
        raise ValueError("no threshold was fitted")
    return local_table(cuts.sparkSession, **{c: [r[c] for r in rows] for c in [*by, "threshold"]})


def apply_thresholds(scored: DataFrame, cuts: DataFrame, by: list[str], y_score: str = "y_score") -> DataFrame:
    """Recompute y_pred for all rows from the frozen cut of their run.

    The cuts are broadcast (see ``frozen``); joining on the run by shuffle would send each run to one
    task.
    """
    table = F.broadcast(frozen(cuts, by))
    joined = scored.drop("y_pred", "threshold").join(table, by, "left")
    return joined.withColumn("y_pred", decide(F.col(y_score).cast("double"), F.col("threshold")))
