"""Average precision, ROC-AUC and the precision-recall curve, exact and free of global sorts.

Scores are first reduced to one row per distinct value. Cumulative counts come from a window inside
each bucket of neighbouring scores plus the totals of the buckets above, so no task ever sees all
the distinct scores of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexsieve.operators.decision import decision_metrics, not_binary
from lexsieve.plans.scale import partitions, written


def ranked_scores(df: DataFrame, by: list[str], y_true: str = "y_true", y_score: str = "y_score",
                  buckets: int | None = None) -> DataFrame:
    """Per distinct score: pos, neg, cumulative tp/fp at ``score >= s`` and the totals P, N.

    Every run has its own bucket bounds, sketched over its own distinct scores, so scores in a narrow band
    spread over as many buckets as any others.
    """
    own = by or ["_run"]
    scored = df.select(*by, F.col(y_true).cast("int").alias("y"), F.col(y_score).cast("double").alias("s"))
    scored = scored if by else scored.withColumn("_run", F.lit(0))
    distinct = written(scored.groupBy(*own, "s").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"),
        F.count_if(F.col("s").isNull() | F.isnan("s") | not_binary(F.col("y"))).alias("bad")), "scores")
    n = buckets or partitions(df.sparkSession)
    cuts = distinct.groupBy(*own).agg(F.percentile_approx("s", [i / n for i in range(1, n)] or [0.5], 10000).alias("cuts"))
    # one row for each run
    distinct = distinct.join(F.broadcast(cuts), own).withColumn(
        "bucket", F.coalesce(F.size(F.filter("cuts", lambda b: b <= F.col("s"))), F.lit(0))).drop("cuts", *set(own) - set(by))
    inner = W.partitionBy(*by, "bucket").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    local = (distinct.withColumn("tp_in", F.sum("pos").over(inner))
             .withColumn("fp_in", F.sum("neg").over(inner)))
    totals = distinct.groupBy(*by, "bucket").agg(
        F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), F.sum("bad").alias("bb"))
    # one row for each bucket of a run from here on
    above = W.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    run = W.partitionBy(*by)
    offsets = totals.select(
        *by, "bucket", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("tp_off"),
        F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("fp_off"),
        F.sum("bp").over(run).alias("P"), F.sum("bn").over(run).alias("N"),
        F.sum("bb").over(run).alias("bad_scores"))
    return local.drop("bad").join(offsets, [*by, "bucket"]).select(
        *by, F.col("s").alias("score"), "pos", "neg", (F.col("tp_in") + F.col("tp_off")).alias("tp"),
        (F.col("fp_in") + F.col("fp_off")).alias("fp"), "P", "N", "bad_scores")


def _defined(value, condition, message: str):
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def _average_precision():
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    ap = F.sum(F.col("pos") * precision) / F.max("P")
    return _defined(ap, (F.max("P") > 0) & (F.max("bad_scores") == 0),
                    "average precision needs positives, labels 0 or 1 and numeric scores")


def _roc_auc():
    below = F.col("N") - F.col("fp") + F.col("neg") / 2
    auc = F.sum(F.col("pos") * below) / F.max("P") / F.max("N")
    return _defined(auc, (F.max("P") > 0) & (F.max("N") > 0) & (F.max("bad_scores") == 0),
                    "ROC-AUC needs both classes, labels 0 or 1 and numeric scores")


def average_precision(df: DataFrame, by: list[str], **kw) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    return ranked_scores(df, by, **kw).groupBy(*by).agg(_average_precision().alias("pr_auc"))


def roc_auc(df: DataFrame, by: list[str], **kw) -> DataFrame:
    """Probability that a positive outranks a negative, ties counted half."""
    return ranked_scores(df, by, **kw).groupBy(*by).agg(_roc_auc().alias("roc_auc"))


def ranking_metrics(df: DataFrame, by: list[str], **kw) -> DataFrame:
    """Both areas from one ranking."""
    return ranked_scores(df, by, **kw).groupBy(*by).agg(
        _average_precision().alias("pr_auc"), _roc_auc().alias("roc_auc"))


def pr_curve(df: DataFrame, by: list[str], **kw) -> DataFrame:
    """Precision and recall at every distinct score, and the closing point (1, 0)."""
    ranked = ranked_scores(df, by, **kw)
    points = ranked.select(*by, F.col("score").alias("threshold"),
                           (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                           (F.col("tp") / F.col("P")).alias("recall"))
    closing = df.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(closing)


def compute_metrics(df: DataFrame, by: list[str], y_true: str = "y_true", y_score: str = "y_score",
                    y_pred: str = "y_pred") -> DataFrame:
    """The full metric block of each run, confusion matrix as [[TN, FP], [FN, TP]]."""
    ranking = ranking_metrics(df, by, y_true=y_true, y_score=y_score)
    decisions = decision_metrics(df, by, y_true, y_pred)
    keys = by or ["_run"]
    if not by:  # a single run: one row on each side
        ranking, decisions = (x.withColumn("_run", F.lit(0)) for x in (ranking, decisions))
    joined = decisions.join(ranking, keys)
    return joined.select(
        *by, "pr_auc", "roc_auc", "f1_macro", "f1_minority", "precision_minority", "recall_minority",
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"))
