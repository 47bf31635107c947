import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexsieve.operators import features as ft
from lexsieve.operators import vocabulary as vo
from lexsieve.sources.vectors import read_vectors, write_vectors

TRAIN = ["petrobras lucro bolsa", "bolsa alta dólar bolsa", "lucro petrobras subir", "jogo gol time", "time vencer jogo",
         "gol gol bolsa", "dólar queda", "novela estrear"]
VAL = ["petrobras novo pregão bolsa", "time valores"]


def grams(text, high):
    t = re.findall(r"\w\w+", text.lower())
    return t + ([f"{a} {b}" for a, b in zip(t, t[1:])] if high == 2 else [])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "train", t) for i, t in enumerate(TRAIN)] + [(100 + i, "val", t) for i, t in enumerate(VAL)]
    return spark.createDataFrame(rows, "doc_id bigint, split string, text string")


def brute_tfidf(high, min_df):
    df = Counter(t for d in TRAIN for t in set(grams(d, high)))
    vocab = sorted(t for t, n in df.items() if n >= min_df)
    out = {}
    for i, text in [*enumerate(TRAIN), *((100 + i, t) for i, t in enumerate(VAL))]:
        tf = {t: n for t, n in Counter(grams(text, high)).items() if t in vocab}
        w = {t: (1 + math.log(n)) * (math.log((1 + len(TRAIN)) / (1 + df[t])) + 1) for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, vocab.index(t)): x / norm for t, x in w.items()})
    return vocab, out


@pytest.mark.parametrize("high, min_df", [(1, 1), (2, 1), (2, 2)])
@pytest.mark.parametrize("limit", [None, 0])
def test_tfidf_matches_brute_force(docs, high, min_df, limit):
    """limit 0 forces the shuffled, salted join that a very large vocabulary takes."""
    fitted = vo.fit_vocabulary(docs.where("split = 'train'"), ngram_range=(1, high), min_df=min_df, max_df=1.0)
    vocab, want = brute_tfidf(high, min_df)
    assert [r["term"] for r in fitted.table.orderBy("term_id").collect()] == vocab
    assert "pregão" not in vocab
    got = {(r["doc_id"], r["term_id"]): r["value"] for r in ft.tfidf(docs, fitted, "doc_id", broadcast_bytes=limit).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_bow_counts_and_vectors(docs):
    fitted = vo.fit_vocabulary(docs.where("split = 'train'"), min_df=1, max_df=1.0)
    vocab = [r["term"] for r in fitted.table.orderBy("term_id").collect()]
    long = ft.bag_of_words(docs, fitted, "doc_id")
    vectors = {r["doc_id"]: r["features"] for r in ft.sparse_vectors(docs, long, fitted.n_terms, "doc_id").collect()}
    for i, text in enumerate(TRAIN):
        counts = Counter(grams(text, 1))
        assert vectors[i].toArray().tolist() == [float(counts.get(t, 0)) for t in vocab]
    assert sum(vectors[101].toArray()) == 1.0  # only "time" is known
    folded = ft.hashed_terms(long, "doc_id", 4)
    assert folded.agg(F.sum("value")).first()[0] == long.agg(F.sum("value")).first()[0]


def test_document_frequency_limits(docs):
    train = docs.where("split = 'train'")
    fitted = vo.fit_vocabulary(train, min_df=2, max_df=0.3)  # at most 2.4 of 8 documents
    assert {r["df"] for r in fitted.table.collect()} == {2}
    with pytest.raises(ValueError):
        vo.fit_vocabulary(train, min_df=50)


def test_vocabulary_ignores_other_splits(spark, docs):
    fitted = vo.fit_vocabulary(docs.where("split = 'train'"), min_df=1, max_df=1.0)
    changed = docs.withColumn("text", F.when(F.col("split") == "val", "outra coisa").otherwise(F.col("text")))
    again = vo.fit_vocabulary(changed.where("split = 'train'"), min_df=1, max_df=1.0)
    assert sorted(fitted.table.collect()) == sorted(again.table.collect())


def test_hot_terms_through_the_salted_join(spark):
    """One term in every document, so far above the hot limit; many rare ones."""
    rows = [(i, f"comum palavra{i % 50:03d} comum") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fitted = vo.fit_vocabulary(df, min_df=1, max_df=1.0)
    plain = ft.bag_of_words(df, fitted, "doc_id").orderBy("doc_id", "term_id").collect()
    salted = ft.bag_of_words(df, fitted, "doc_id", broadcast_bytes=0).orderBy("doc_id", "term_id").collect()
    assert plain == salted and len(plain) == 800


@pytest.mark.parametrize("limit", [None, 0])
def test_embedding_average(spark, limit):
    dictionary = spark.createDataFrame([("petrobras", [1.0] * 4), ("lucro", [2.0] * 4), ("bolsa", [3.0] * 4)], "token string, vec array<float>")
    texts = ["petrobras lucro", "petrobras xyz lucro", "lucro lucro bolsa", "", None, "nada aqui"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: list(r["vector"]) for r in ft.embedding_average(docs, dictionary, 3, 4, "doc_id", broadcast_bytes=limit).collect()}
    want = {0: [1.5] * 4, 1: [1.5] * 4, 2: [7 / 3] * 4, 3: [0.0] * 4, 4: [0.0] * 4, 5: [0.0] * 4}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_vector_file(spark, tmp_path):
    path = tmp_path / "v.vec"
    lines = ["4 3", "petrobras 1 1 1", "lucro 2 2 2", "short 1", "bolsa 3 3 3", "lucro 5 5 5"]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    everything = {r["token"]: list(r["vec"]) for r in read_vectors(spark, str(path), dim=3).collect()}
    assert everything == {"petrobras": [1.0] * 3, "lucro": [5.0] * 3, "bolsa": [3.0] * 3}
    wanted = spark.createDataFrame([("lucro",), ("xyzunk",)], "token string")
    assert [r["token"] for r in read_vectors(spark, str(path), wanted, dim=3).collect()] == ["lucro"]
    with pytest.raises(ValueError, match="dimension"):
        read_vectors(spark, str(path), dim=50)
    write_vectors(read_vectors(spark, str(path), dim=3), str(tmp_path / "out"))
    assert {r["token"]: list(r["vec"]) for r in read_vectors(spark, str(tmp_path / "out"), dim=3).collect()} == everything


def test_texts_are_placed_by_their_size(docs, monkeypatch):
    """The partitions that documents are taken apart in follow the bytes of text, whatever the session's number is."""
    from lexsieve.operators.cleaning import clean_aggressive
    from lexsieve.plans import scale

    monkeypatch.setattr(scale, "TEXT_BYTES", 4)
    fitted = vo.fit_vocabulary(docs.where("split = 'train'"), min_df=1, max_df=1.0)
    size = sum(len(t.encode()) for t in TRAIN + VAL)
    spark = docs.sparkSession
    stops = spark.createDataFrame([("bolsa", None, True)], "token string, lemma string, is_stop boolean")
    for found in (ft.bag_of_words(docs, fitted, "doc_id"), ft.tfidf(docs, fitted, "doc_id"), clean_aggressive(docs, stops, 1, "doc_id")):
        assert found.rdd.getNumPartitions() == -(-size // 4) > 32


def test_averages_by_cells_copy_no_vector_to_its_documents(spark, monkeypatch):
    """Several cells of tokens and documents; one token in every document, repeated tokens, a document twice, string ids."""
    monkeypatch.setattr(ft, "VECTOR_BYTES", 8 * 3 * 5)
    monkeypatch.setattr(ft, "CELL_ROWS", 20)
    dictionary = spark.createDataFrame([(f"w{i}", [float(i), -1.0, i / 7]) for i in range(30)], "token string, vec array<double>")
    texts = {f"d{k}": " ".join(["w0"] + [f"w{(k * j) % 37}" for j in range(k % 9)]) for k in range(60)}
    docs = spark.createDataFrame([*texts.items(), ("d7", texts["d7"])], "doc_id string, text string")
    made = []
    seen = ft._partial_sums
    monkeypatch.setattr(ft, "_partial_sums", lambda *a: made.append(seen(*a)) or made[-1])
    got = ft.embedding_average(docs, dictionary, 30, 3, "doc_id", broadcast_bytes=0).collect()
    assert len(got) == 61
    for r in got:
        ids = [int(w[1:]) for w in texts[r["doc_id"]].split() if int(w[1:]) < 30]
        assert list(r["vector"]) == pytest.approx([sum(ids) / len(ids), -1.0, sum(ids) / len(ids) / 7])
    sizes = made[0].groupBy("doc_id").count().collect()
    assert 1 < max(r["count"] for r in sizes) <= 6  # a row for each cell of tokens, not for each token
