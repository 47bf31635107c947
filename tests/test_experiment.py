"""Cells of the experiment leave whole runs behind, and a second start takes up where the first was killed."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexsieve.operators import reports
from lexsieve.plans import experiment, matrix
from lexsieve.sources.runs import check_metadata

SCHEME = {"keep": ("mercado", "esporte"), "sink": "outros"}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        split, day = ("train", 1) if k < 80 else ("val", 2) if k < 100 else ("test", 3)
        positive = k % 4 == 0
        words = rng.choices("juros bolsa selic lucro".split() if positive else "gol time ator vacina".split(), k=6) + rng.choices(["hoje", "novo"], k=2)
        rows.append((k, split, " ".join(words), int(positive), "mercado" if positive else ("esporte", "saude", "cidade")[k % 3], dt.datetime(2020, 1, day), f"l{k:03d}"))
    return spark.createDataFrame(rows, "doc_id bigint, split string, text string, label int, category string, date timestamp_ntz, link string")


def clock():
    ticks = itertools.count()
    return lambda: dt.datetime(2026, 1, 2, 3) + dt.timedelta(seconds=next(ticks))


def test_an_interrupted_experiment_is_resumed(spark, corpus, tmp_path, monkeypatch):
    ledger = experiment.Ledger(spark, str(tmp_path / "ledger"))
    built, scored = [], []
    make = lambda name: lambda: built.append(name) or matrix.build_features(corpus, name, min_df=1)
    score = experiment.score_model

    def dying(features, model, *rest):
        scored.append((features.representation, model, rest[0]))
        if len(scored) == 3:
            raise KeyboardInterrupt
        return score(features, model, *rest)

    monkeypatch.setattr(experiment, "score_model", dying)
    start = lambda: experiment.run_experiment(
        ledger, corpus, {"bow": make("bow"), "tfidf": make("tfidf")}, ("multinomialnb", "complementnb"), (("binary", None), ("multiclass", SCHEME)),
        positive="mercado", now=tick)
    tick = clock()
    with pytest.raises(KeyboardInterrupt):
        start()
    assert ledger.runs().count() == 2 and built == ["bow"]
    # rows of a run that was not committed are not seen
    spark.createDataFrame([(1, 1, 1, 0.5)], "index bigint, y_true int, y_pred int, y_score double").write.parquet(f"{ledger.path}/predictions/run_id=lost")
    assert len(start()) == 6 and start() == []
    assert built == ["bow", "bow", "tfidf"] and len(scored) == 9 and len(set(scored)) == 8
    meta = check_metadata(ledger.runs())
    assert meta.select("model", "variant").distinct().count() == meta.count() == 8
    per_run = {r["run_id"]: r["count"] for r in ledger.predictions().groupBy("run_id").count().collect()}
    assert len(per_run) == 8 and set(per_run.values()) == {20}
    summary = reports.run_summary(ledger.runs()).collect()
    assert {r["target_tag"] for r in summary} == {"bin", "mc3"} and all(r["n_test"] == 20 and r["latency_ms_per_1k"] > 0 for r in summary)
    assert all(r["f1_minority"] > 0.9 for r in summary)
    coded = ledger.runs().where("config.target.mode = 'multiclass'").select("config.target.*").collect()
    assert len(coded) == 4 and all((r["num_classes"], r["positive_class_code"], r["class_encoding"]) == (3, 1, {"esporte": 0, "mercado": 1, "outros": 2}) for r in coded)
    # stored decisions and metrics belong together
    wrong = ledger.predictions().where("y_true <> y_pred").groupBy("run_id").count().collect()
    cells = {r["run_id"]: r["metrics"]["confusion_matrix"] for r in ledger.runs().collect()}
    assert {k: m[0][1] + m[1][0] for k, m in cells.items() if m[0][1] + m[1][0]} == {r["run_id"]: r["count"] for r in wrong}


def test_impossible_cells_raise_before_anything_runs(spark, corpus, tmp_path):
    ledger = experiment.Ledger(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        experiment.run_experiment(ledger, corpus, {"bow": lambda: 1 / 0}, ("logreg",), (("multiclass", None),))
    with pytest.raises(ValueError, match="no rows"):
        experiment.windows_block(corpus.where(F.col("split") != "val"))
    assert ledger.runs().count() == 0
