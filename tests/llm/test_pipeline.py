"""The pipeline against brute force, each stage on what its predecessor kept."""

import os

import pytest

import corpus_pipeline
from lexsieve.llm.queries import ORACLE, QUERIES
from lexsieve.plans.scale import written
from tests.llm.test_dedup import classes_of, deduped

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_stages_take_effect(spark):
    docs = corpus_pipeline.table(spark, FOLDER, "documents")
    columns, texts = docs.columns, lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["ordinal quality", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]
    seen = [texts(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns
        seen.append(texts(docs))
    start, good, single, cut, clean = seen

    quality = {r["doc_id"]: r["quality"] for r in corpus_pipeline.table(spark, FOLDER, "labels").collect()}
    assert {i for i in start if quality.get(i) == 1} <= set(good) and not any(quality.get(i) == 0 for i in good)
    assert set(single) == {c for c, _, _ in classes_of(list(good.items())).values()}
    assert {i: len(t.split()) for i, t in cut.items()} == {i: len(w[3]) for i, w in deduped(list(single.items())).items()}
    items = [r["text"] for r in corpus_pipeline.table(spark, FOLDER, "benchmark").collect()]
    leaking = {i for i, t in cut.items() if any(x in t for x in items)}
    assert leaking and leaking.isdisjoint(clean) and len(set(cut) - set(clean)) <= len(leaking) + 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == set(clean)


def test_stages_on_edge_rows(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([(10, 0, 1), (15, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == edge_docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
