"""Run registry: metadata documents and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.functions import fixed

METADATA_SCHEMA = """
    run_id string, git_commit string, started_at string, finished_at string,
    generation string, model string, variant string,
    config struct<
        seed: bigint, mask_entities: boolean, preprocess: string, representation: string,
        target: struct<mode: string, num_classes: bigint, positive_class_label: string,
                       positive_class_code: bigint, collapse_scheme: string,
                       class_encoding: map<string, bigint>>,
        prompt: struct<version: string, hash: string>,
        scoring: struct<method_counts: struct<logprobs: bigint, hard: bigint, parse_failure: bigint>>,
        bucket: string, max_length: bigint, epochs: double>,
    split struct<train_window: array<string>, val_window: array<string>, test_window: array<string>,
                 n_train: bigint, n_val: bigint, n_test: bigint>,
    threshold struct<fitted_on: string, value: double, objective: string, applicable: boolean>,
    metrics struct<pr_auc: double, roc_auc: double, f1_macro: double, f1_minority: double,
                   precision_minority: double, recall_minority: double,
                   confusion_matrix: array<array<bigint>>>,
    efficiency struct<latency_ms_per_1k: double, vram_peak_mb: double, n_processed: bigint, n_total: bigint>
"""
PREDICTION_SCHEMA = "index bigint, y_true int, y_pred int, y_score double"


def check_metadata(meta: DataFrame) -> DataFrame:
    """Raise, when the rows are read, for a run without one of the required keys.

    The commit is a required key whose value may be null, so only its column is checked.
    """
    absent = [k for k in fixed.RUN_METADATA_KEYS if k not in meta.columns]
    if absent:
        raise ValueError(f"run metadata lacks the keys {absent}")
    needed = [k for k in fixed.RUN_METADATA_KEYS if k != "git_commit"]
    gaps = F.concat_ws(", ", *[F.when(F.col(k).isNull(), F.lit(k)) for k in needed])
    guard = F.when(gaps != "", F.raise_error(F.concat(F.lit("run metadata lacks "), gaps)).cast("string"))
    return meta.withColumn("run_id", F.coalesce(guard, F.col("run_id")))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Every metadata document below ``path``; folders without one contribute nothing."""
    docs = (spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("mode", "FAILFAST")
            .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path))
    return check_metadata(docs.where(F.col("run_id").isNotNull() | F.col("config").isNotNull()))


def write_runs(meta: DataFrame, path: str) -> None:
    """One JSON document per run, each in the folder of its run."""
    named = check_metadata(meta).withColumn("run", F.col("run_id"))
    (named.repartition("run").write.mode("append").option("ignoreNullFields", False)
     .partitionBy("run").json(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all runs from ``<path>/<run_id>/predictions.csv``."""
    rows = (spark.read.schema(PREDICTION_SCHEMA).option("header", True).option("mode", "FAILFAST")
            .csv(f"{path.rstrip('/')}/*/predictions.csv"))
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(run.alias("run_id"), "index", "y_true", "y_pred", "y_score")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Append to the predictions table, one folder per run; incomplete rows raise."""
    cells = ["index", "y_true", "y_pred", "y_score"]
    gap = sum((F.col(c).isNull().cast("int") for c in cells), F.lit(0)) > 0
    guard = F.when(gap, F.raise_error(F.lit("a prediction lacks a value")).cast("string"))
    (predictions.select(F.coalesce(guard, F.col("run_id")).alias("run_id"), *cells)
     .write.mode("append").partitionBy("run_id").parquet(path))


def predictions_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA + ", run_id string").parquet(path)
