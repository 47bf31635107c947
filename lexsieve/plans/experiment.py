"""A resumable experiment: every cell (representation, model, target) leaves a run behind.

The ledger is a folder with two tables. ``predictions`` has the decided test rows of each run, ``runs`` one metadata
document per run: configuration, windows, threshold, metrics, latency. The document is written last and commits the
run: a cell without one is done again, and rows of a run that never got that far belong to no registered run. A repeated
start therefore skips what is finished; a representation is only built while it has open cells.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.functions import fixed
from lexsieve.functions.labels import collapse_category, encode_classes, resolve_scheme, run_name, variant_name, variant_tag
from lexsieve.operators.ranking import compute_metrics
from lexsieve.operators.reports import METRICS
from lexsieve.operators.scoring import timed_latency_per_1k
from lexsieve.operators.split import split_windows
from lexsieve.operators.threshold import decide, fit_threshold
from lexsieve.plans.matrix import Features, check_models, score_model
from lexsieve.plans.scale import written
from lexsieve.sources.runs import METADATA_SCHEMA, PREDICTION_SCHEMA, read_runs, write_runs

GENERATION = "gen1"
Target = tuple[str, object]


@dataclass(frozen=True)
class Ledger:
    """Finished runs below a folder that all executors share."""

    spark: SparkSession
    path: str

    def runs(self) -> DataFrame:
        """Metadata of the committed runs."""
        try:
            return read_runs(self.spark, f"{self.path}/runs")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], METADATA_SCHEMA)

    def predictions(self) -> DataFrame:
        """(run_id, index, y_true, y_pred, y_score) of the committed runs."""
        rows = self.spark.read.schema(PREDICTION_SCHEMA + ", run_id string").parquet(f"{self.path}/predictions")
        return rows.join(F.broadcast(self.runs().select("run_id")), "run_id", "left_semi")  # one row per run

    def finished(self) -> set[tuple[str, str]]:
        """(model, variant) of the committed runs; as many as there are cells."""
        return {(r["model"], r["variant"]) for r in self.runs().select("model", "variant").collect()}

    def commit(self, meta: dict, predictions: DataFrame) -> None:
        # a repeated run id replaces what an interrupted attempt left
        predictions.write.mode("overwrite").parquet(f"{self.path}/predictions/run_id={meta['run_id']}")
        write_runs(self.spark.createDataFrame([meta], METADATA_SCHEMA), f"{self.path}/runs")


def _target_block(features: Features, mode: str, scheme, positive: str) -> dict:
    if mode == "binary":
        return {"mode": mode, "num_classes": 2, "positive_class_label": "1", "positive_class_code": 1}
    spec = resolve_scheme(scheme, positive)
    train = features.docs.where(F.col("split") == "train")
    codes = encode_classes(train.select(collapse_category("category", spec["keep"], spec["sink"]).alias("c")), "c", positive)
    return {"mode": mode, "num_classes": len(codes), "positive_class_label": positive, "positive_class_code": codes[positive],
            "collapse_scheme": scheme if isinstance(scheme, str) else "custom", "class_encoding": codes}


def _run_cell(ledger: Ledger, features: Features, model: str, target: Target, windows: dict, now: Callable[[], dt.datetime],
              positive: str, trees: int) -> str:
    mode, scheme = target
    started = now()
    variant = variant_name(features.representation, features.cleaning, variant_tag(mode, scheme))
    run_id = run_name(GENERATION, model, variant, started)
    scores = score_model(features, model, mode, scheme, positive, trees)
    truth = features.docs.where(F.col("split") != "train").select(features.doc_id, "split", F.col("label").cast("int").alias("y_true"))
    scored = written(truth.join(scores, features.doc_id), "scores")
    decision = fit_threshold(scored.where(F.col("split") == "val"))
    test = scored.where(F.col("split") == "test").select(
        F.col(features.doc_id).cast("bigint").alias("index"), "y_true", decide("y_score", decision).alias("y_pred"), "y_score")
    metrics = compute_metrics(test, []).first()
    ledger.commit({
        "run_id": run_id, "git_commit": None, "started_at": started.isoformat(), "finished_at": now().isoformat(),
        "generation": GENERATION, "model": model, "variant": variant,
        "config": {"seed": fixed.SEED, "mask_entities": features.cleaning == "aggressive", "preprocess": features.cleaning,
                   "representation": features.representation, "target": _target_block(features, mode, scheme, positive)},
        "split": windows,
        "threshold": {"fitted_on": decision.fitted_on, "value": decision.value, "objective": decision.objective, "applicable": True},
        "metrics": {**{m: metrics[m] for m in METRICS}, "confusion_matrix": [list(r) for r in metrics["confusion_matrix"]]},
        "efficiency": {"latency_ms_per_1k": timed_latency_per_1k(scores), "vram_peak_mb": 0.0,
                       "n_processed": windows["n_val"] + windows["n_test"], "n_total": windows["n_val"] + windows["n_test"]},
    }, test)
    return run_id


def windows_block(split: DataFrame) -> dict:
    """First and last day and rows of each part, as run metadata has them."""
    parts = {r["split"]: r for r in split_windows(split).collect()}  # three rows
    missing = [s for s in ("train", "val", "test") if s not in parts]
    if missing:
        raise ValueError(f"the split has no rows of {missing}")
    return {**{f"{s}_window": [parts[s]["window_start"], parts[s]["window_end"]] for s in parts}, **{f"n_{s}": parts[s]["n"] for s in parts}}


def run_experiment(ledger: Ledger, split: DataFrame, representations: dict[str, Callable[[], Features]], models: tuple[str, ...],
                   targets: tuple[Target, ...], *, cleaning: str = "raw", positive: str = fixed.POSITIVE_CATEGORY, trees: int = 100,
                   now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) -> list[str]:
    """Run every open cell and return the new run ids.

    ``representations`` gives, for each name, a function that builds its features. Models that need non-negative features are
    left out for embeddings, as the matrix of the reports has it; anything else that does not fit raises before a cell runs.
    """
    cells = []
    for name in representations:
        fitting = [m for m in models if name != "fasttext" or m not in fixed.NON_NEGATIVE_CLASSIFIERS]
        for mode, scheme in targets:
            check_models(name, fitting, mode, scheme)
            cells += [(name, model, (mode, scheme)) for model in fitting]
    done = ledger.finished()
    windows, built, new = None, {}, []
    for name, model, target in cells:
        if (model, variant_name(name, cleaning, variant_tag(*target))) in done:
            continue
        if name not in built:
            built = {name: representations[name]()}  # one representation at a time
            if built[name].cleaning != cleaning:
                raise ValueError(f"features are {built[name].cleaning}, the experiment is {cleaning}")
        windows = windows or windows_block(split)
        new.append(_run_cell(ledger, built[name], model, target, windows, now, positive, trees))
    return new
