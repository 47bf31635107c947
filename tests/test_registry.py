import json

import pytest
from pyspark.sql import functions as F

from lexsieve.operators import reports
from lexsieve.sources import corpus as src
from lexsieve.sources import runs as reg


def document(run_id, mode="binary", f1=0.8, **extra):
    return {"run_id": run_id, "git_commit": None, "started_at": "a", "finished_at": "b", "generation": run_id.split("__")[1],
            "model": run_id.split("__")[2], "variant": run_id.split("__")[3],
            "config": {"seed": 1, "preprocess": "aggressive", "representation": "tfidf",
                       "target": {"mode": mode, "num_classes": 8 if mode == "multiclass" else 2}},
            "split": {"train_window": ["2015", "2016"], "n_train": 10, "n_val": 2, "n_test": 3},
            "threshold": {"fitted_on": "val", "value": 0.4, "objective": "f1_minority"},
            "metrics": {"pr_auc": 0.7, "roc_auc": 0.9, "f1_macro": 0.8, "f1_minority": f1, "precision_minority": 0.8,
                        "recall_minority": 0.8, "confusion_matrix": [[3, 1], [2, 4]]},
            "efficiency": {"latency_ms_per_1k": 2.5}, **extra}


@pytest.fixture
def folder(tmp_path):
    for doc in (document("20260101-000000__gen1__logreg__tfidf-aggr-bin"), document("20260102-000000__gen1__logreg__tfidf-aggr-bin", f1=0.7),
                document("20260103-000000__gen1__logreg__tfidf-aggr-mc8", "multiclass", 0.9), document("20260104-000000__gen2__enc__raw-ml256-bin", f1=0.9)):
        run = tmp_path / "runs" / doc["run_id"]
        run.mkdir(parents=True)
        (run / "metadata.json").write_text(json.dumps(doc, indent=2, sort_keys=True), encoding="utf-8")
        (run / "predictions.csv").write_text("index,y_true,y_pred,y_score\n0,0,0,0.1\n1,1,1,0.9\n2,1,0,0.4\n")
    (tmp_path / "runs" / "empty").mkdir()
    return str(tmp_path / "runs")


def test_summary_pairs_champions(spark, folder, tmp_path):
    meta = reg.read_runs(spark, folder)
    summary = reports.run_summary(meta)
    rows = {r["run_id"]: r for r in summary.collect()}
    assert len(rows) == 4 and {r["target_tag"] for r in rows.values()} == {"bin", "mc8"}
    assert all(r["vram_peak_mb"] == 0 and r["n_parse_failure"] == 0 and r["threshold_applicable"] is False for r in rows.values())
    assert reports.run_summary(meta, "gen1", "-aggr-").count() == 3
    pairs = reports.paired_runs(summary, ["representation", "model"]).collect()
    assert len(pairs) == 2  # the repeated binary run multiplies
    assert sorted(round(p["delta_f1_minority"], 6) for p in pairs) == [0.1, 0.2]
    best = {r["generation"]: r["run_id"] for r in reports.champions(summary).collect()}
    assert best["gen1"].startswith("20260103") and best["gen2"].startswith("20260104")
    assert reports.latest_run(summary, "gen1", "logreg", "tfidf-aggr-bin").first()["run_id"].startswith("20260102")
    assert reports.latest_run(summary, "gen1", "svc", "x").collect() == []
    again = str(tmp_path / "again")
    reg.write_runs(meta, again)
    assert sorted(reports.run_summary(reg.read_runs(spark, again)).collect()) == sorted(summary.collect())


def test_missing_metadata_key_raises(spark, tmp_path):
    doc = document("20260101-000000__gen1__m__v")
    del doc["efficiency"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "metadata.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="efficiency"):
        reg.read_runs(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        reg.check_metadata(spark.range(1))


def test_predictions(spark, folder, tmp_path):
    pred = reg.read_predictions(spark, folder)
    assert pred.count() == 12
    one = [tuple(r) for r in pred.where(F.col("run_id").startswith("20260101")).orderBy("index").collect()]
    assert [r[1:] for r in one] == [(0, 0, 0, 0.1), (1, 1, 1, 0.9), (2, 1, 0, 0.4)]
    path = str(tmp_path / "table")
    reg.write_predictions(pred, path)
    assert sorted(reg.predictions_table(spark, path).select(*pred.columns).collect()) == sorted(pred.collect())
    with pytest.raises(Exception, match="lacks a value"):
        reg.write_predictions(pred.withColumn("y_score", F.lit(None).cast("double")), str(tmp_path / "bad"))


CSV = 'title,text,date,category,link,subcategory\nT1,"linha um\nlinha ""dois""",2020-01-02,mercado,l2,\nT2,NA,2020-01-01,esporte,l1,x\n'


def test_csv_conversion(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(CSV, encoding="utf-8")
    out = str(tmp_path / "corpus")
    summary = src.convert_csv(spark, str(path), out).first()
    assert (summary["n"], summary["n_positive"], str(summary["date_min"])[:10]) == (2, 1, "2020-01-01")
    corpus = src.load_corpus(spark, out).orderBy("date").collect()
    assert [r["label"] for r in corpus] == [0, 1] and corpus[0]["text"] is None and corpus[1]["text"] == 'linha um\nlinha "dois"'
    path.write_text(CSV.replace("2020-01-02", "02/xx"), encoding="utf-8")
    with pytest.raises(Exception):
        src.convert_csv(spark, str(path), out).collect()
    path.write_text("title,text\na,b\n", encoding="utf-8")
    with pytest.raises(ValueError, match="lacks"):
        src.read_corpus_csv(spark, str(path))
    with pytest.raises(TypeError):
        src.with_label(spark.range(1).selectExpr(*[f"'x' as {c}" for c in ("title", "text", "date", "category", "link")]))


def test_digests_ignore_order_and_see_changes(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "k int, s string")
    base = src.content_digest(df).first()
    assert base["n_rows"] == 4 and src.content_digest(df.repartition(3)).first() == base
    assert src.content_digest(df.na.fill("")).first()["digest"] != base["digest"]
    assert src.content_digest(df.where("k <> 1")).first()["digest"] != base["digest"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_bytes(b"abc")
    got = src.file_sha256(spark, str(tmp_path / "f")).first()
    assert got["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_split_table_roundtrip_and_report(spark, tiny_corpus, tmp_path):
    from lexsieve.operators import split as sp

    split = sp.split_out_of_time(tiny_corpus)
    src.write_splits(split, str(tmp_path / "s"))
    back = src.read_splits(spark, str(tmp_path / "s"))
    assert {r["split"]: r["n"] for r in sp.split_windows(back).collect()} == {"train": 34, "val": 4, "test": 2}
    src.write_report(sp.describe_split(split), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3
    runs = spark.createDataFrame([("tfidf", "b", 1), ("bow", "z", 2), ("bow", "a", 3)], "representation string, model string, n int").repartition(3)
    src.write_report(runs, str(tmp_path / "o"))
    src.write_report(runs, str(tmp_path / "p"), ["n"])
    lines = {x: next((tmp_path / x).glob("*.csv")).read_text().split() for x in "op"}
    assert lines == {"o": ["representation,model,n", "bow,a,3", "bow,z,2", "tfidf,b,1"], "p": ["representation,model,n", "tfidf,b,1", "bow,z,2", "bow,a,3"]}
