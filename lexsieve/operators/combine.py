"""Ensembles of two runs, weights of terms, listings of errors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.operators.linear_solver import logistic, solve_linear


def paired_scores(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """y_true and both scores on the rows two runs share; differing truth raises."""
    left = a.select(*keys, F.col("y_true").alias("ta"), F.col("y_score").alias("score_a"))
    right = b.select(*keys, F.col("y_true").alias("tb"), F.col("y_score").alias("score_b"))
    truth = F.when(F.col("ta") == F.col("tb"), F.col("ta")).otherwise(
        F.raise_error(F.lit("true labels differ between the combined runs")).cast("int"))
    return left.join(right, keys).select(*keys, truth.alias("y_true"), "score_a", "score_b")


def scores_of_two(scored: DataFrame, run_a: str, run_b: str, keys: list[str], run: str = "run_id") -> DataFrame:
    """``paired_scores`` of two runs that lie in one table, by one aggregate; every (run, key) has one row."""
    is_a, is_b, truth = F.col(run) == run_a, F.col(run) == run_b, F.col("y_true")
    both = scored.where(is_a | is_b).groupBy(*keys).agg(
        F.max(F.when(is_a, F.col("y_score"))).alias("score_a"), F.max(F.when(is_b, F.col("y_score"))).alias("score_b"),
        F.min(truth).alias("least"), F.max(truth).alias("y_true"))
    agreed = F.when(F.col("least") == F.col("y_true"), F.col("y_true")).otherwise(
        F.raise_error(F.lit("true labels differ between the combined runs")).cast("int"))
    return both.where("score_a is not null and score_b is not null").select(*keys, agreed.alias("y_true"), "score_a", "score_b")


def soft_vote(pair: DataFrame) -> DataFrame:
    """Mean of the two probabilities."""
    return pair.withColumn("y_score", (F.col("score_a") + F.col("score_b")) / 2)


def stack(pair: DataFrame, split: str = "split") -> DataFrame:
    """Logistic meta-model on the two scores, fitted on val, applied to the other rows.

    Penalty 1/2 on the squared weights of the sum of losses, intercept free, solved by Newton steps.
    """
    val = pair.where(F.col(split) == "val").select("y_true", array_to_vector(F.array("score_a", "score_b")).alias("features"))
    if val.isEmpty():
        raise ValueError("stacking needs validation rows")
    fitted = solve_linear(val, 2, [(1, None)], label="y_true", loss=logistic, penalise_intercept=False, tol=1e-9)
    a, b, shift = (float(w) for w in fitted.weights[:, 0])
    z = a * F.col("score_a") + b * F.col("score_b") + shift
    return pair.where(F.col(split) != "val").withColumn("y_score", 1.0 / (1.0 + F.exp(-z)))


def error_samples(scored: DataFrame, k: int, key: str) -> DataFrame:
    """The k most confident false positives and the k most confident false negatives."""
    wrong = scored.where(F.col("y_true") != F.col("y_pred"))
    fp = wrong.where("y_pred = 1").orderBy(F.desc("y_score"), key).limit(k).withColumn("error", F.lit("false_positive"))
    fn = wrong.where("y_pred = 0").orderBy(F.asc("y_score"), key).limit(k).withColumn("error", F.lit("false_negative"))
    return fp.unionByName(fn)
