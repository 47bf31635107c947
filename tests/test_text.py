import unicodedata

import pytest
from pyspark.sql import functions as F

from lexsieve.functions import fixed
from lexsieve.functions import labels as lab
from lexsieve.functions import text as tx
from lexsieve.operators.cleaning import clean_aggressive, cleaned_table, token_dictionary

MONEY, PERCENT = fixed.MONEY_TOKEN, fixed.PERCENT_TOKEN


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in df.select("i", fn("s").alias("o")).orderBy("i").collect()]


def test_masks(spark):
    money = ["R$ 10 bi", "R$10", "R$ 1.234,56", "US$ 2,5 milhões", "US$ 500 mil", "$100", "R$ 3 bilhões", "R$ 3 trilhão",
             "R$ 3 BILHÕES", "R$ 10 bi"]
    assert column(spark, money, tx.mask_entities) == [MONEY] * len(money)
    assert column(spark, ["5%", "5,2%", "0.5%", "100 %"], tx.mask_entities) == [PERCENT] * 4
    same = ["Em 2023, 10 empresas com 50 funcionários cada."]
    assert column(spark, same, tx.mask_entities) == same
    assert column(spark, ["R$ 10 bilhete"], tx.mask_entities) == [f"{MONEY} bilhete"]
    text = "Entre R$ 1 mi e R$ 10 mi, alta de 5%."
    once = column(spark, [text], tx.mask_entities)
    assert once == [f"Entre {MONEY} e {MONEY}, alta de {PERCENT}."] and column(spark, once, tx.mask_entities) == once


def test_clean_raw(spark):
    values = [None, "", "  ", "ok", "   Bom dia   ", "café", "\x1c　Ação! ", "R$ 5"]
    want = ["", "", "", "ok", "Bom dia", "café", "Ação!", "R$ 5"]
    assert column(spark, values, tx.clean_raw) == want
    assert column(spark, ["R$ 5"], lambda c: tx.clean_raw(c, mask=True)) == [MONEY]


def test_normalization_shortcut_is_exact():
    import re

    stable = [cp for a, b in ((0, 0x2FF), (0x2002, 0x205E), (0x20A0, 0x20BF)) for cp in range(a, b + 1)]
    marks = [chr(cp) for cp in range(0x300, 0x345)]
    for cp in stable:
        ch = chr(cp)
        assert unicodedata.normalize("NFC", ch) == ch and unicodedata.combining(ch) == 0
        assert not re.search(tx._NFC_UNSTABLE, ch)
    assert all(re.search(tx._NFC_UNSTABLE, m) for m in marks)


def test_whitespace_tokens_follow_python(spark):
    values = ["", "  ", "a  b\tc", " x\x1cy z ", "um"]
    assert column(spark, values, tx.whitespace_tokens) == [v.split() for v in values]


def test_word_tokens_and_ngrams(spark):
    assert column(spark, ["Ação e a_b X1 é"], tx.word_tokens) == [["ação", "a_b", "x1"]]
    got = column(spark, ["aa bb cc dd", "aa", ""], lambda c: tx.ngrams(tx.word_tokens(c), 1, 3))
    assert got == [["aa", "bb", "cc", "dd", "aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd"], ["aa"], []]
    with pytest.raises(ValueError):
        tx.ngrams(F.array(F.lit("a")), 2, 1)


def test_slugs_and_run_names(spark):
    import datetime as dt

    cases = {"LinearSVC": "linearsvc", "Encoder/base": "encoder-base", "  Foo  Bar! ": "foo-bar", "a_b": "a-b",
             "model+v2": "model+v2", "news 1.2.3": "news-1.2.3", "---edge---": "edge", "!!!": ""}
    assert column(spark, list(cases), lab.slug) == list(cases.values())
    assert [lab.kebab(c) for c in cases] == list(cases.values())
    when = dt.datetime(2026, 4, 21, 14, 30, 5)
    name = lab.run_name("gen1", "LinearSVC", "tfidf-lemmatized", when)
    assert name == "20260421-143005__gen1__linearsvc__tfidf-lemmatized"
    parts = lab.run_name_parts(F.lit(name))
    row = spark.range(1).select(*[c.alias(k) for k, c in parts.items()]).first()
    assert (row["generation"], row["model"], row["variant"]) == ("gen1", "linearsvc", "tfidf-lemmatized")
    with pytest.raises(ValueError):
        lab.run_name("gen9", "m", "v", when)
    with pytest.raises(ValueError):
        lab.run_name("gen1", "!!!", "v", when)


def test_targets(spark):
    spec = lab.resolve_scheme("top7_plus_other")
    assert lab.num_classes(spec) == 8 and lab.variant_tag("multiclass", "top7_plus_other") == "mc8"
    df = spark.createDataFrame([("mercado",), ("saude",), (None,), ("poder",)], "category string")
    collapsed = df.select(lab.collapse_category("category", spec["keep"], spec["sink"]).alias("c"))
    assert [r["c"] for r in collapsed.collect()] == ["mercado", "outros", "outros", "poder"]
    assert lab.encode_classes(collapsed, "c", "mercado") == {"mercado": 0, "outros": 1, "poder": 2}
    assert [r[0] for r in df.select(lab.binary_label("category")).collect()] == [1, 0, 0, 0]
    with pytest.raises(ValueError):
        lab.encode_classes(collapsed.where("c <> 'mercado'"), "c", "mercado")
    with pytest.raises(ValueError):
        lab.resolve_scheme("unknown")
    with pytest.raises(ValueError):
        lab.variant_tag("multiclass", None)


def test_aggressive_cleaning_on_both_join_paths(spark):
    docs = spark.createDataFrame(
        [(1, "As Ações da Petrobras subiram 5%, a R$ 10 mil!"), (2, None), (3, "de a"), (4, "lucros e LUCROS")], "doc_id int, text string")
    stops = spark.createDataFrame([("as",), ("da",), ("a",), ("de",), ("e",)], "word string")
    lemmas = spark.createDataFrame([("ações", "ação"), ("subiram", "subir"), ("lucros", "lucro")], "form string, lemma string")
    table, n = token_dictionary(stops, lemmas)
    want = {1: "ação petrobras subir percentual valor_monetario", 2: "", 3: "", 4: "lucro lucro"}
    for limit in (None, 0):
        got = clean_aggressive(docs, table, n, "doc_id", broadcast_bytes=limit)
        assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_cleaned_table_is_reused_until_rows_change(spark, tmp_path):
    split = spark.createDataFrame([("train", "l1", " A "), ("train", "l2", None), ("val", "l3", "b")], "split string, link string, text string")
    path = str(tmp_path / "clean")
    first = {r["link"]: r["text"] for r in cleaned_table(split, path, "raw").collect()}
    assert first == {"l1": "A", "l2": "", "l3": "b"}
    assert {r["link"]: r["text"] for r in cleaned_table(split, path, "raw").collect()} == first
    edited = split.withColumn("text", F.when(F.col("link") == "l3", "c").otherwise(F.col("text")))
    with pytest.raises(ValueError, match="force"):
        cleaned_table(edited, path, "raw")
    fewer = split.where("link <> 'l3'")
    with pytest.raises(ValueError, match="force"):
        cleaned_table(fewer, path, "raw")
    assert cleaned_table(fewer, path, "raw", force=True).count() == 2
    with pytest.raises(ValueError):
        cleaned_table(split, path, "other")


def test_counted_terms_equal_the_arrays_and_are_not_interpreted(spark):
    """Words and pairs are laid out by generated code, without an array of joined pairs for each document."""
    from lexsieve.operators import vocabulary as vo

    docs = spark.createDataFrame([("aa bb aa bb",), ("aa",), ("",), (None,), ("Cc a bb cc",)], "text string")
    found = vo.counted_terms(docs, "text", (1, 2))
    assert dict(found.collect()) == {"aa": 3, "bb": 3, "cc": 2, "aa bb": 2, "bb aa": 1, "cc bb": 1, "bb cc": 1}
    assert sorted(vo.counted_terms(docs, "text", (1, 3)).where("term like '% % %'").collect()) == [("aa bb aa", 1), ("bb aa bb", 1), ("cc bb cc", 1)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "zip_with" not in plan and plan.count("regexp_extract_all") == 1
