"""Cross-run reports over the run registry and the predictions table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexsieve.functions.labels import target_tag
from lexsieve.operators.mcnemar import compare_pairs, run_pairs, winner

METRICS = ("pr_auc", "roc_auc", "f1_macro", "f1_minority", "precision_minority", "recall_minority")
PAIR_COLUMNS = ("f1_minority", "pr_auc", "precision_minority", "recall_minority", "latency_ms_per_1k", "threshold", "run_id")


def run_summary(meta: DataFrame, generation: str | None = None, variant_contains: str | None = None) -> DataFrame:
    """One flat row per run; optional fields default as the registry defines them."""
    runs = meta
    if generation is not None:
        runs = runs.where(F.col("generation") == generation)
    if variant_contains is not None:
        runs = runs.where(F.col("variant").contains(variant_contains))
    mode = F.coalesce("config.target.mode", F.lit("binary"))
    classes = F.coalesce("config.target.num_classes", F.lit(2)).cast("bigint")
    counts = {s: F.coalesce(f"config.scoring.method_counts.{s}", F.lit(0)).cast("bigint")
              for s in ("logprobs", "hard", "parse_failure")}
    return runs.select(
        "run_id", "generation", "model", "variant",
        F.col("config.representation").alias("representation"), F.col("config.preprocess").alias("preprocess"),
        mode.alias("target_mode"), target_tag(mode, F.col("config.target.num_classes")).alias("target_tag"),
        F.col("config.target.collapse_scheme").alias("collapse_scheme"), classes.alias("num_classes"),
        F.col("threshold.value").alias("threshold"),
        F.coalesce("threshold.applicable", F.lit(False)).alias("threshold_applicable"),
        *[F.col(f"metrics.{m}").alias(m) for m in METRICS],
        F.col("efficiency.latency_ms_per_1k").alias("latency_ms_per_1k"),
        F.coalesce("efficiency.vram_peak_mb", F.lit(0.0)).alias("vram_peak_mb"),
        F.coalesce("efficiency.n_processed", F.lit(0)).cast("bigint").alias("n_processed"),
        F.coalesce("efficiency.n_total", F.lit(0)).cast("bigint").alias("n_total"),
        counts["logprobs"].alias("n_logprobs"), counts["hard"].alias("n_hard_fallback"),
        counts["parse_failure"].alias("n_parse_failure"), F.col("split.n_test").alias("n_test"))


def paired_runs(summary: DataFrame, keys: list[str], multiclass_tag: str = "mc8") -> DataFrame:
    """Binary and multiclass runs side by side, with differences; repeated keys multiply."""
    def side(tag: str, suffix: str) -> DataFrame:
        return summary.where(F.col("target_tag") == tag).select(
            *keys, *[F.col(c).alias(f"{c}_{suffix}") for c in PAIR_COLUMNS])

    joined = side("bin", "bin").join(side(multiclass_tag, "mc"), keys)
    return joined.withColumn("delta_f1_minority", F.col("f1_minority_mc") - F.col("f1_minority_bin")).withColumn(
        "delta_pr_auc", F.col("pr_auc_mc") - F.col("pr_auc_bin"))


def mcnemar_pairs(predictions: DataFrame, paired: DataFrame, keys: list[str]) -> DataFrame:
    """Paired test of every binary run against its multiclass twin."""
    pairs = paired.select(*keys, F.col("run_id_bin").alias("run_a"), F.col("run_id_mc").alias("run_b"))
    return compare_pairs(predictions, pairs).withColumn("winner", winner("binary", "multiclass"))


def champions(summary: DataFrame, metric: str = "f1_minority") -> DataFrame:
    """Best run of each generation; equal runs are settled by the earlier run_id."""
    best = W.partitionBy("generation").orderBy(F.desc(metric), "run_id")  # runs, a report dimension
    return summary.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def latest_run(summary: DataFrame, generation: str, model: str, variant: str) -> DataFrame:
    """The newest run whose name contains generation, model and the start of the variant."""
    pattern = f"__{generation}__{model}__{variant}"
    return summary.where(F.col("run_id").contains(pattern)).agg(F.max("run_id").alias("run_id")).where(
        F.col("run_id").isNotNull())


def versus_champion(predictions: DataFrame, summary: DataFrame, champion_id: str) -> DataFrame:
    """Every other run against one champion; runs without a common row are skipped."""
    champ = summary.where(F.col("run_id") == champion_id).select("model", "variant", "f1_minority").first()
    if champ is None:
        raise ValueError(f"no run {champion_id!r} to compare with")
    pairs = summary.where(F.col("run_id") != champion_id).select(
        F.lit(champion_id).alias("run_a"), F.col("run_id").alias("run_b"), "model", "variant", "target_tag", "f1_minority",
        F.lit(f"{champ['model']}__{champ['variant']}").alias("champion"),
        F.lit(champ["f1_minority"]).alias("champion_f1_minority"))
    return (compare_pairs(predictions, pairs).withColumn("winner", winner("champion", "challenger"))
            .withColumn("delta_f1_minority", F.col("f1_minority") - F.col("champion_f1_minority")))


def mcnemar_matrix(predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """All unordered pairs of runs."""
    return compare_pairs(predictions, run_pairs(runs)).withColumn("winner", winner("a", "b"))


def win_tally(tests: DataFrame) -> DataFrame:
    """Pairs, significant pairs, significant wins of each side, the rest."""
    sig = F.col("significant")
    return tests.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(sig).alias("significant"),
        F.count_if(sig & (F.col("winner") == "multiclass")).alias("multiclass_wins"),
        F.count_if(sig & (F.col("winner") == "binary")).alias("binary_wins"),
        F.count_if(~sig).alias("not_significant"))


def cost_quality(summary: DataFrame) -> DataFrame:
    return summary.select("run_id", "generation", "representation", "model", "target_tag",
                          "latency_ms_per_1k", "f1_minority")
