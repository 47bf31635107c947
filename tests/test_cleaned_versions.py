"""Versions of the cleaned text against cleaning everything anew."""

import pytest
from pyspark.sql import functions as F

from lexsieve.functions.text import clean_raw
from lexsieve.operators.cleaning import token_dictionary
from lexsieve.sources import cleaned_versions as cv

SCHEMA = "split string, link string, text string"
ROWS = [("train", "l1", " A "), ("train", "l2", None), ("val", "l3", "b"), ("val", "l3", "b"), ("test", None, "n"), ("test", "", "n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def same_as_anew(split, path, version=None):
    got = sorted(map(repr, map(tuple, cv.cleaned_rows(split, path, "raw", version=version).drop("added_in").collect())))
    assert got == sorted(map(repr, map(tuple, split.select("split", "link", clean_raw("text")).collect())))


def test_only_changes_are_cleaned_and_old_versions_stay(spark, tmp_path):
    path = str(tmp_path)
    first = frame(spark, ROWS)
    assert cv.versions(spark, path, "raw").count() == 0
    one = cv.refresh_cleaned(first, path, "raw")
    assert (one.version, one.base, one.added, one.retired, one.live) == (1, 1, 5, 0, 5)
    same_as_anew(first, path)
    assert cv.refresh_cleaned(first.repartition(3), path, "raw") == one  # nothing to write
    moved = frame(spark, [("val", *r[1:]) for r in ROWS])
    assert cv.refresh_cleaned(moved, path, "raw") == one  # a split that moved is not cleaned again
    same_as_anew(moved, path)

    second = frame(spark, [("train", "l1", " A2 "), *ROWS[1:3], ("test", "l9", "new")])  # one edited, one added, two removed
    two = cv.refresh_cleaned(second, path, "raw", compact_at=None)
    assert (two.version, two.base, two.added, two.retired, two.live, two.stored) == (2, 1, 2, 3, 4, 7)
    same_as_anew(second, path)
    same_as_anew(first, path, version=1)
    three = cv.refresh_cleaned(first, path, "raw", compact_at=None)  # everything comes back
    assert (three.added, three.retired, three.live) == (3, 2, 5)
    same_as_anew(first, path)
    assert {r["link"]: r["added_in"] for r in cv.cleaned_rows(first, path, "raw").collect()} == {"l1": 3, "l2": 1, "l3": 1, None: 3, "": 3}
    with pytest.raises(ValueError, match="no version"):
        cv.cleaned_rows(first, path, "raw", version=9)


def test_uncommitted_files_are_not_seen_and_written_over(spark, tmp_path):
    path, split = str(tmp_path), frame(spark, ROWS)
    cv.refresh_cleaned(split, path, "raw")
    stray = frame(spark, [("train", "l1", "x")]).select(cv.row_id("link").alias("row_id"), F.lit("wrong").alias("text"))
    stray.write.parquet(f"{path}/mode=raw/data/v=2")  # a run that ended before its manifest
    stray.select("row_id").write.parquet(f"{path}/mode=raw/gone/v=2")
    same_as_anew(split, path)
    edited = frame(spark, [("train", "l1", "x"), *ROWS[1:]])
    assert cv.refresh_cleaned(edited, path, "raw").version == 2
    same_as_anew(edited, path)


def test_compaction_and_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    cv.refresh_cleaned(frame(spark, ROWS), path, "raw")
    edited = frame(spark, [("train", "l1", "z"), ("train", "l2", None)])
    two = cv.refresh_cleaned(edited, path, "raw", compact_at=0.5)
    assert (two.base, two.stored, two.live) == (2, 2, 2)
    same_as_anew(edited, path)
    none = cv.refresh_cleaned(frame(spark, []), path, "raw")
    assert (none.live, none.retired) == (0, 2)
    assert cv.cleaned_rows(edited, path, "raw").count() == 0
    assert cv.refresh_cleaned(frame(spark, ROWS), path, "raw").live == 5
    same_as_anew(frame(spark, ROWS), path)


def test_another_dictionary_starts_over(spark, tmp_path):
    path, split = str(tmp_path), frame(spark, [("train", "l1", "O gato viu casas"), ("val", "l2", None)])
    stops = spark.createDataFrame([("o",)], "word string")
    lemmas = [spark.createDataFrame([("casas", x)], "form string, lemma string") for x in ("casa", "lar")]
    dictionaries = [token_dictionary(stops, x) for x in lemmas]
    with pytest.raises(ValueError, match="dictionary"):
        cv.refresh_cleaned(split, path, "aggressive")
    with pytest.raises(ValueError, match="mode"):
        cv.refresh_cleaned(split, path, "other")
    for number, (dictionary, word) in enumerate(zip(dictionaries, ("casa", "lar")), start=1):
        done = cv.refresh_cleaned(split, path, "aggressive", dictionary=dictionary)
        assert (done.version, done.base, done.live) == (number, number, 2)
        texts = {r["link"]: r["text"] for r in cv.cleaned_rows(split, path, "aggressive").collect()}
        assert texts == {"l1": f"gato viu {word}", "l2": ""}
    assert cv.refresh_cleaned(split, path, "aggressive", dictionary=dictionaries[1]) == done
