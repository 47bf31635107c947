"""Run registry and cross-run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.evaluation_queries import tested_sql
from catalog.registry import query
from catalog.views import RUN_IDS, RUNS, WITH_SUMMARY, decided, r6, variant
from lexsieve.operators import ranking, reports
from lexsieve.operators.scoring import latency_per_1k
from lexsieve.plans.scale import durable, local_table, new_folder, written
from lexsieve.sources import runs as registry


def metadata(spark, sf, rows=None):
    """Metadata documents of the runs, their metrics taken from the test rows."""
    rows = written(decided(spark, sf), "decided") if rows is None else rows
    test = rows.where(F.col("split") == "test")
    metrics = ranking.compute_metrics(test, ["run_id"])
    facts = test.groupBy("run_id").agg(F.first("threshold").alias("cut"), F.count(F.lit(1)).alias("n_test"))
    per_run = metrics.join(facts, "run_id").join(latency_per_1k(test, ["run_id"]), "run_id")
    fixed_part = local_table(
        spark, run_id=list(RUN_IDS), generation=[r[1] for r in RUNS], model=[r[2] for r in RUNS],
        variant=[variant(r) for r in RUNS], representation=[r[3] for r in RUNS],
        mode=["multiclass" if r[5] > 2 else "binary" for r in RUNS], classes=[r[5] if r[5] > 2 else None for r in RUNS])
    c = F.col
    return per_run.join(F.broadcast(fixed_part), "run_id").select(
        "run_id", F.lit(None).cast("string").alias("git_commit"), F.lit("2026-01-05T09:00:00+00:00").alias("started_at"),
        F.lit("2026-01-05T09:30:00+00:00").alias("finished_at"), "generation", "model", "variant",
        F.struct(F.lit(1).cast("bigint").alias("seed"), c("representation"), F.lit("aggressive").alias("preprocess"),
                 F.struct(c("mode"), c("classes").alias("num_classes")).alias("target")).alias("config"),
        F.struct(c("n_test")).alias("split"),
        F.struct(F.lit("val").alias("fitted_on"), c("cut").alias("value"), F.lit("f1_minority").alias("objective")).alias("threshold"),
        F.struct(*reports.METRICS, "confusion_matrix").alias("metrics"),
        F.struct("latency_ms_per_1k").alias("efficiency"))


def summary_of(spark, sf, rows=None):
    """Write the documents, read them back, flatten."""
    path = new_folder(spark, "runs")
    registry.write_runs(metadata(spark, sf, rows), path)
    return reports.run_summary(registry.read_runs(spark, path))


_ROUNDED = "".join(f", round({m}, 6) AS {m}" for m in (*reports.METRICS, "latency_ms_per_1k"))


@query("run_summary", WITH_SUMMARY + f"""SELECT run_id, generation, model, variant, representation, target_tag,
  CASE target_tag WHEN 'mc8' THEN 'multiclass' ELSE 'binary' END AS target_mode, CASE target_tag WHEN 'mc8' THEN 8 ELSE 2 END::BIGINT AS num_classes,
  threshold, n_test, 0.0::DOUBLE AS vram_peak_mb, 0::BIGINT AS n_parse_failure{_ROUNDED} FROM summary""")
def run_summary(spark, sf):
    return summary_of(spark, sf).select(
        "run_id", "generation", "model", "variant", "representation", "target_tag", "target_mode", "num_classes",
        "threshold", "n_test", "vram_peak_mb", "n_parse_failure",
        *[r6(F.col(m), m) for m in (*reports.METRICS, "latency_ms_per_1k")])


_PAIRED = """paired AS (SELECT a.representation, a.model, a.run_id AS run_id_bin, b.run_id AS run_id_mc, a.f1_minority AS f1_a, b.f1_minority AS f1_b,
  a.pr_auc AS ap_a, b.pr_auc AS ap_b FROM summary a JOIN summary b ON a.representation = b.representation AND a.model = b.model
  WHERE a.target_tag = 'bin' AND b.target_tag = 'mc8')"""


@query("paired_runs", WITH_SUMMARY + f""", {_PAIRED} SELECT representation, model, run_id_bin, run_id_mc, round(f1_a, 6) AS f1_minority_bin, round(f1_b, 6) AS f1_minority_mc,
  round(f1_b - f1_a, 6) AS delta_f1_minority, round(ap_b - ap_a, 6) AS delta_pr_auc FROM paired""")
def paired_runs(spark, sf):
    out = reports.paired_runs(summary_of(spark, sf), ["representation", "model"])
    return out.select("representation", "model", "run_id_bin", "run_id_mc",
                      *[r6(F.col(c), c) for c in ("f1_minority_bin", "f1_minority_mc", "delta_f1_minority", "delta_pr_auc")])


def _pair_counts(pairs: str, keys: str, condition: str = "") -> str:
    return f"""SELECT {keys}, count(*) AS n_rows, count(*) FILTER (WHERE a.y_pred = a.y_true AND b.y_pred <> b.y_true) AS b,
    count(*) FILTER (WHERE a.y_pred <> a.y_true AND b.y_pred = b.y_true) AS c
    FROM {pairs} JOIN decided a ON a.run_id = run_a JOIN decided b ON b.run_id = run_b AND a.index = b.index
    WHERE a.split = 'test' {condition} GROUP BY {keys}"""


_TEST_COLUMNS = "n_rows, b, c, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS significant"
_MC_PAIRS = "pairs AS (SELECT representation, model, run_id_bin AS run_a, run_id_mc AS run_b FROM paired)"
_MC_TESTED = f", {_PAIRED}, {_MC_PAIRS}, " + tested_sql(_pair_counts("pairs", "representation, model"))
_WINNER = "CASE WHEN c > b THEN '{b}' WHEN b > c THEN '{a}' ELSE 'tie' END AS winner"


def _tests(frame, *keys):
    return frame.select(*keys, "n_rows", "b", "c", r6(F.col("statistic"), "statistic"), r6(F.col("p_value"), "p_value"),
                        "significant", "winner")


def _decided_test(spark, sf):
    """Decided rows of all splits, fixed once because metadata and tests both read them."""
    rows = durable(decided(spark, sf))
    return rows, rows.where(F.col("split") == "test")


@query("mcnemar_pairs", WITH_SUMMARY + _MC_TESTED + f" SELECT representation, model, {_TEST_COLUMNS}, {_WINNER.format(a='binary', b='multiclass')} FROM tested")
def mcnemar_pairs(spark, sf):
    rows, test = _decided_test(spark, sf)
    paired = reports.paired_runs(summary_of(spark, sf, rows), ["representation", "model"])
    return _tests(reports.mcnemar_pairs(test, paired, ["representation", "model"]), "representation", "model")


@query("win_tally", WITH_SUMMARY + _MC_TESTED + """ SELECT count(*) AS pairs, count(*) FILTER (WHERE p_value < 0.05) AS significant,
  count(*) FILTER (WHERE p_value < 0.05 AND c > b) AS multiclass_wins, count(*) FILTER (WHERE p_value < 0.05 AND b > c) AS binary_wins,
  count(*) FILTER (WHERE p_value >= 0.05) AS not_significant FROM tested""")
def win_tally(spark, sf):
    rows, test = _decided_test(spark, sf)
    paired = reports.paired_runs(summary_of(spark, sf, rows), ["representation", "model"])
    return reports.win_tally(reports.mcnemar_pairs(test, paired, ["representation", "model"]))


@query("champion", WITH_SUMMARY + """SELECT generation, run_id, round(f1_minority, 6) AS f1_minority FROM summary
  QUALIFY row_number() OVER (PARTITION BY generation ORDER BY f1_minority DESC, run_id) = 1""")
def champion(spark, sf):
    return reports.champions(summary_of(spark, sf)).select("generation", "run_id", r6(F.col("f1_minority"), "f1_minority"))


@query("latest_run", WITH_SUMMARY + "SELECT max(run_id) AS run_id FROM summary WHERE contains(run_id, '__gen1__logreg__tfidf-aggr')")
def latest_run(spark, sf):
    return reports.latest_run(summary_of(spark, sf), "gen1", "logreg", "tfidf-aggr")


_CHAMP = "champ AS (SELECT run_id AS champ_id, model || '__' || variant AS champion, f1_minority AS champ_f1 FROM summary WHERE generation = 'gen1' ORDER BY f1_minority DESC, run_id LIMIT 1)"


@query("vs_champion", WITH_SUMMARY + f", {_CHAMP}, pairs AS (SELECT champ_id AS run_a, run_id AS run_b, champion, f1_minority - champ_f1 AS delta FROM summary, champ WHERE run_id <> champ_id), "
       + tested_sql(_pair_counts("pairs", "run_b, champion, delta")) +
       f" SELECT run_b, champion, round(delta, 6) AS delta_f1_minority, {_TEST_COLUMNS}, {_WINNER.format(a='champion', b='challenger')} FROM tested")
def vs_champion(spark, sf):
    rows, test = _decided_test(spark, sf)
    summary = durable(summary_of(spark, sf, rows))
    best = reports.champions(summary).where(F.col("generation") == "gen1").first()["run_id"]
    out = reports.versus_champion(test, summary, best).withColumn("delta_f1_minority", r6(F.col("delta_f1_minority")))
    return _tests(out, "run_b", "champion", "delta_f1_minority")


@query("mcnemar_matrix", WITH_SUMMARY + ", pairs AS (SELECT a.run_id AS run_a, b.run_id AS run_b FROM summary a JOIN summary b ON a.run_id < b.run_id), "
       + tested_sql(_pair_counts("pairs", "run_a, run_b")) + f" SELECT run_a, run_b, {_TEST_COLUMNS}, {_WINNER.format(a='a', b='b')} FROM tested")
def mcnemar_matrix(spark, sf):
    test = decided(spark, sf).where(F.col("split") == "test")
    runs = local_table(spark, run_id=list(RUN_IDS))
    return _tests(reports.mcnemar_matrix(test, runs), "run_a", "run_b")


@query("cost_quality", WITH_SUMMARY + """SELECT run_id, generation, representation, model, target_tag, round(latency_ms_per_1k, 6) AS latency_ms_per_1k,
  round(f1_minority, 6) AS f1_minority FROM summary""")
def cost_quality(spark, sf):
    return reports.cost_quality(summary_of(spark, sf)).withColumns(
        {c: r6(F.col(c)) for c in ("latency_ms_per_1k", "f1_minority")})
