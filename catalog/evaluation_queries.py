"""Thresholds, metrics and paired tests over the scored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.newton import newton_ctes
from catalog.registry import query
from catalog.views import RUN_IDS, WITH_DECIDED, WITH_PRED, decided, predictions, r6
from lexsieve.operators import combine, decision, mcnemar, ranking, threshold
from lexsieve.operators.scoring import latency_per_1k
from lexsieve.plans.scale import written

_GROUP = ["run_id", "split"]

# erfc by the all-positive series of erf, good to the six places compared; exact tail by binomials
PVALUE_SQL = """CASE WHEN b + c = 0 THEN 1.0::DOUBLE
  WHEN b + c < 25 THEN least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0)))
      FROM range(0, 25) r(i) WHERE i <= least(b, c)) / pow(2.0::DOUBLE, b + c))
  ELSE greatest(0.0::DOUBLE, 1 - coalesce((SELECT sum(exp(n * ln(2.0::DOUBLE) + (2 * n + 1) * ln(z) - z * z - (lgamma(2.0 * n + 2) - n * ln(2.0::DOUBLE) - lgamma(n + 1.0))))
      FROM range(0, 400) s(n)) * 2 / sqrt(pi()), 0)) END"""
STATISTIC_SQL = """CASE WHEN b + c = 0 THEN 0.0::DOUBLE WHEN b + c < 25 THEN least(b, c)::DOUBLE
  ELSE pow(abs(b - c) - 1.0::DOUBLE, 2) / (b + c) END"""


def tested_sql(counts: str) -> str:
    """Wrap a query giving b and c into one that adds statistic and p_value."""
    return f"""st AS (SELECT *, {STATISTIC_SQL} AS statistic FROM ({counts})),
zs AS (SELECT *, CASE WHEN b + c >= 25 THEN least(sqrt(statistic / 2), 12.0::DOUBLE) END AS z FROM st),
tested AS (SELECT *, {PVALUE_SQL} AS p_value FROM zs)"""


@query("threshold_sweep", WITH_DECIDED + """SELECT run_id, threshold, tp, fp, fn, tn, round(f1_minority, 6) AS f1_minority,
  round((f1_minority + f1_negative) / 2, 6) AS f1_macro FROM sweep""")
def threshold_sweep(spark, sf):
    val = predictions(spark, sf).where(F.col("split") == "val")
    return threshold.threshold_sweep(val, ["run_id"]).withColumns(
        {c: r6(F.col(c)) for c in ("f1_minority", "f1_macro")})


@query("threshold_fit", WITH_DECIDED + """, macro AS (SELECT run_id, threshold FROM sweep QUALIFY row_number() OVER (PARTITION BY run_id
    ORDER BY (f1_minority + f1_negative) / 2 DESC, threshold) = 1)
  SELECT run_id, cuts.threshold AS cut_minority, round(f1_minority, 6) AS f1_minority, macro.threshold AS cut_macro FROM cuts JOIN macro USING (run_id)""")
def threshold_fit(spark, sf):
    val = predictions(spark, sf).where(F.col("split") == "val")
    best = threshold.best_thresholds(val, ["run_id"])
    return best.select("run_id", F.col("f1_minority.threshold").alias("cut_minority"), r6(F.col("f1_minority.value"), "f1_minority"),
                       F.col("f1_macro.threshold").alias("cut_macro"))


@query("apply_threshold", WITH_DECIDED + "SELECT run_id, split, index, y_true, y_pred FROM decided")
def apply_threshold(spark, sf):
    return decided(spark, sf).select("run_id", "split", "index", "y_true", "y_pred")


_CONF = """conf AS (SELECT run_id, split, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp FROM decided GROUP BY 1, 2)"""


@query("confusion_matrix", WITH_DECIDED + f", {_CONF} SELECT * FROM conf")
def confusion_matrix(spark, sf):
    return decision.confusion(decided(spark, sf), _GROUP)


@query("decision_metrics", WITH_DECIDED + f""", {_CONF} SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision_minority,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall_minority, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_minority,
  round((coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS f1_macro FROM conf""")
def decision_metrics(spark, sf):
    out = decision.decision_metrics(decided(spark, sf), _GROUP)
    return out.withColumns({c: r6(F.col(c)) for c in out.columns[6:]})


_RANKED = """per_score AS (SELECT run_id, split, y_score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg
    FROM pred GROUP BY ALL),
ranked AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY run_id, split) AS p, sum(neg) OVER (PARTITION BY run_id, split) AS n
  FROM per_score WINDOW w AS (PARTITION BY run_id, split ORDER BY y_score DESC))"""


@query("average_precision", WITH_PRED + f", {_RANKED} SELECT run_id, split, round(sum(pos * tp::DOUBLE / (tp + fp)) / any_value(p), 6) AS pr_auc FROM ranked GROUP BY 1, 2")
def average_precision(spark, sf):
    return ranking.average_precision(predictions(spark, sf), _GROUP).withColumn("pr_auc", r6(F.col("pr_auc")))


@query("roc_auc", WITH_PRED + f", {_RANKED} SELECT run_id, split, round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / any_value(p) / any_value(n), 6) AS roc_auc FROM ranked GROUP BY 1, 2")
def roc_auc(spark, sf):
    return ranking.roc_auc(predictions(spark, sf), _GROUP).withColumn("roc_auc", r6(F.col("roc_auc")))


@query("pr_curve", WITH_PRED + f""", {_RANKED} SELECT run_id, split, round(y_score, 6) AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / p, 6) AS recall FROM ranked
  UNION ALL SELECT DISTINCT run_id, split, NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM pred""")
def pr_curve(spark, sf):
    out = ranking.pr_curve(predictions(spark, sf), _GROUP)
    return out.withColumns({c: r6(F.col(c)) for c in ("threshold", "precision", "recall")})


@query("compute_metrics", WITH_DECIDED + """, m AS (SELECT run_id, split, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn,
    count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp FROM decided GROUP BY 1, 2), """ + _RANKED + """,
  a AS (SELECT run_id, split, round(sum(pos * tp::DOUBLE / (tp + fp)) / any_value(p), 6) AS pr_auc,
    round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / any_value(p) / any_value(n), 6) AS roc_auc FROM ranked GROUP BY 1, 2)
  SELECT run_id, split, pr_auc, roc_auc, tn, tp FROM m JOIN a USING (run_id, split)""")
def compute_metrics(spark, sf):
    cm = F.col("confusion_matrix")
    return ranking.compute_metrics(decided(spark, sf), _GROUP).select(
        "run_id", "split", r6(F.col("pr_auc"), "pr_auc"), r6(F.col("roc_auc"), "roc_auc"),
        cm[0][0].alias("tn"), cm[1][1].alias("tp"))


_AB = f"""ab AS (SELECT a.split, a.index, a.y_true, a.y_pred AS y_a, b.y_pred AS y_b FROM decided a JOIN decided b ON a.index = b.index
  WHERE a.run_id = '{RUN_IDS[0]}' AND b.run_id = '{RUN_IDS[1]}')"""


@query("mcnemar", WITH_DECIDED + f", {_AB}, " + tested_sql("""SELECT split, count(*) FILTER (WHERE y_a = y_true AND y_b <> y_true) AS b,
    count(*) FILTER (WHERE y_a <> y_true AND y_b = y_true) AS c FROM ab GROUP BY split""") +
       " SELECT split, b, c, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM tested")
def mcnemar_by_split(spark, sf):
    rows = decided(spark, sf).where(F.col("run_id").isin(*RUN_IDS[:2]))
    side = {r: F.max(F.when(F.col("run_id") == r, F.col("y_pred"))) for r in RUN_IDS[:2]}
    both = rows.groupBy("split", "index").agg(
        F.max("y_true").alias("y_true"), side[RUN_IDS[0]].alias("y_a"), side[RUN_IDS[1]].alias("y_b"))
    return mcnemar.mcnemar(both, ["split"]).withColumns(
        {c: r6(F.col(c)) for c in ("statistic", "p_value")})


@query("latency_per_1k", WITH_PRED + "SELECT run_id, split, round(sum(latency_s) * 1e6 / count(*), 6) AS latency_ms_per_1k FROM pred GROUP BY 1, 2")
def latency(spark, sf):
    return latency_per_1k(predictions(spark, sf), _GROUP).withColumn("latency_ms_per_1k", r6(F.col("latency_ms_per_1k")))


_VOTE = f"""v AS (SELECT a.split, a.index, a.y_true, (a.y_score + b.y_score) / 2 AS s FROM pred a JOIN pred b ON a.index = b.index
  WHERE a.run_id = '{RUN_IDS[1]}' AND b.run_id = '{RUN_IDS[5]}'),
vcells AS (SELECT threshold, count(*) FILTER (WHERE y_true = 1 AND s >= threshold) AS tp, count(*) FILTER (WHERE y_true = 0 AND s >= threshold) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND s < threshold) AS fn FROM v, grid WHERE split = 'val' GROUP BY threshold),
vcut AS (SELECT threshold FROM vcells ORDER BY coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) DESC, threshold LIMIT 1)"""


@query("soft_vote", WITH_DECIDED + f", {_VOTE} SELECT split, index, y_true, round(s, 6) AS y_score, CASE WHEN s >= threshold THEN 1 ELSE 0 END AS y_pred FROM v, vcut")
def soft_vote(spark, sf):
    pred = predictions(spark, sf)
    pair = combine.scores_of_two(pred, RUN_IDS[1], RUN_IDS[5], ["split", "index"])
    voted = written(combine.soft_vote(pair), "voted")
    cut = threshold.fit_threshold(voted.where(F.col("split") == "val"))
    return voted.select("split", "index", "y_true", r6(F.col("y_score"), "y_score"),
                        threshold.decide("y_score", cut).alias("y_pred"))


_STACK = f"""{WITH_PRED},
two AS (SELECT split, index, any_value(y_true) AS y, max(y_score) FILTER (WHERE run_id = '{RUN_IDS[1]}') AS x1, max(y_score) FILTER (WHERE run_id = '{RUN_IDS[5]}') AS x2
  FROM pred WHERE run_id IN ('{RUN_IDS[1]}', '{RUN_IDS[5]}') GROUP BY split, index),
val AS (SELECT 0 AS grp, * FROM two WHERE split = 'val'),
{newton_ctes("meta", "val", "logistic", penalise_intercept=False)},
scored AS (SELECT split, y, 1 / (1 + exp(-(w1 * x1 + w2 * x2 + w0))) AS p FROM two, meta WHERE split <> 'val'),
per AS (SELECT split, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY split, p),
rk AS (SELECT *, sum(pos) OVER w AS tpc, sum(neg) OVER w AS fpc, sum(pos) OVER (PARTITION BY split) AS np, sum(neg) OVER (PARTITION BY split) AS nn
  FROM per WINDOW w AS (PARTITION BY split ORDER BY p DESC))
SELECT split, round(sum(pos * tpc::DOUBLE / (tpc + fpc)) / any_value(np), 6) AS pr_auc, round(sum(pos * (nn - fpc + neg / 2.0::DOUBLE)) / any_value(np) / any_value(nn), 6) AS roc_auc
FROM rk GROUP BY split"""


@query("stacking", _STACK)
def stacking(spark, sf):
    pred = predictions(spark, sf)
    pair = written(combine.scores_of_two(pred, RUN_IDS[1], RUN_IDS[5], ["split", "index"]), "pair")
    stacked = combine.stack(pair)
    return ranking.ranking_metrics(stacked, ["split"]).withColumns(
        {c: r6(F.col(c)) for c in ("pr_auc", "roc_auc")})


@query("error_samples", WITH_DECIDED + f""", wrong AS (SELECT index, y_true, y_pred, y_score FROM decided WHERE run_id = '{RUN_IDS[5]}' AND split = 'test' AND y_true <> y_pred)
  SELECT w.index, y_true, y_pred, round(y_score, 6) AS y_score, error, category FROM (
    (SELECT *, 'false_positive' AS error FROM wrong WHERE y_pred = 1 ORDER BY y_score DESC, index LIMIT 10)
    UNION ALL (SELECT *, 'false_negative' AS error FROM wrong WHERE y_pred = 0 ORDER BY y_score, index LIMIT 10)) w JOIN corpus ON doc_id = w.index""")
def error_samples(spark, sf):
    from catalog.views import orders_corpus

    rows = decided(spark, sf).where((F.col("run_id") == RUN_IDS[5]) & (F.col("split") == "test")).select(
        "index", "y_true", "y_pred", "y_score")
    errors = combine.error_samples(rows, 10, "index")
    corpus = orders_corpus(spark, sf).select(F.col("doc_id").alias("index"), "category")
    return corpus.join(F.broadcast(errors), "index").withColumn("y_score", r6(F.col("y_score")))  # 20 rows
