import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexsieve.operators import profile
from lexsieve.operators import split as sp


def links(df, name):
    return {r["link"] for r in df.where(F.col("split") == name).collect()}


def test_sizes_ties_and_conservation(tiny_corpus):
    got = sp.split_out_of_time(tiny_corpus)
    parts = {s: links(got, s) for s in ("train", "val", "test")}
    assert [len(parts[s]) for s in ("train", "val", "test")] == [34, 4, 2]
    assert {x for x in parts["train"] if x.startswith("08-")} == {f"08-{n}" for n in range(28, 34)}
    assert all(x.startswith("09-") for x in parts["val"]) and all(x.startswith("10-") for x in parts["test"])
    assert set().union(*parts.values()) == {r["link"] for r in tiny_corpus.collect()}
    described = {r["split"]: r for r in sp.describe_split(got).collect()}
    assert [described[s]["pos_count"] for s in ("train", "val", "test")] == [4, 1, 1]
    assert described["val"]["pos_ratio"] == 0.25


def test_same_split_after_shuffling(spark, tiny_corpus):
    rows = tiny_corpus.collect()
    random.Random(7).shuffle(rows)
    shuffled = spark.createDataFrame(rows, tiny_corpus.schema).repartition(5)
    a, b = sp.split_out_of_time(tiny_corpus), sp.split_out_of_time(shuffled)
    assert {(r["link"], r["split"]) for r in a.collect()} == {(r["link"], r["split"]) for r in b.collect()}


@pytest.mark.parametrize("train, val", [(0.95, 0.1), (0.0, 0.1), (0.5, 1.0)])
def test_bad_fractions(tiny_corpus, train, val):
    with pytest.raises(ValueError):
        sp.split_out_of_time(tiny_corpus, train, val)


def test_too_few_dates_null_dates_and_no_positives(spark):
    schema = "date timestamp_ntz, link string, label int"
    d1, d2 = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)
    with pytest.raises(ValueError, match="empty"):
        sp.split_bounds(spark.createDataFrame([(d1, "a", 1), (d1, "b", 1), (d2, "c", 1)], schema))
    with pytest.raises(ValueError, match="no date"):
        sp.split_bounds(spark.createDataFrame([(d1, "a", 1), (None, "b", 1), (d2, "c", 1)], schema))
    with pytest.raises(ValueError, match="3 rows"):
        sp.split_bounds(spark.createDataFrame([(d1, "a", 1)], schema))
    many = [(d1 + dt.timedelta(days=i), str(i), 0) for i in range(20)]
    with pytest.raises(ValueError, match="positive"):
        sp.split_bounds(spark.createDataFrame(many, schema))


def test_boundaries_inside_a_day(spark):
    """Half of the rows fall into one day, with several equal time stamps."""
    rng = random.Random(3)
    base = dt.datetime(2020, 5, 1)
    stamps = [base + dt.timedelta(seconds=rng.randrange(40), microseconds=rng.choice([0, 5, 9])) for _ in range(60)]
    stamps += [base + dt.timedelta(days=rng.randrange(1, 20)) for _ in range(50)]
    df = spark.createDataFrame([(s, str(i), 1) for i, s in enumerate(stamps)], "date timestamp_ntz, link string, label int")
    for train, val in ((0.3, 0.2), (0.5, 0.3), (0.1, 0.1)):
        bounds = sp.split_bounds(df, train, val)
        order = sorted(stamps)
        assert bounds.train_end == order[int(len(order) * train)]
        assert bounds.val_end == order[int(len(order) * (train + val))]
        whole = df.withColumn("split", bounds.column())
        for part in ("train", "val", "test"):
            assert bounds.part(df, part).count() == whole.where(F.col("split") == part).count()


def test_row_index_matches_sorted_order(tiny_corpus):
    got = sp.split_row_index(sp.split_out_of_time(tiny_corpus).repartition(7))
    for part in ("train", "val", "test"):
        rows = sorted(got.where(F.col("split") == part).collect(), key=lambda r: (r["date"], r["link"]))
        assert [r["index"] for r in rows] == list(range(len(rows)))


def test_invariants_hold(tiny_corpus):
    rows = sp.split_invariants(sp.split_out_of_time(tiny_corpus)).collect()
    assert len(rows) == 3 and all(r["non_empty"] and r["has_positive"] and r["after_prior"] for r in rows)


def test_profile_totals_and_audit(tiny_corpus):
    split = sp.split_out_of_time(tiny_corpus)
    summary = {r["split"]: r for r in profile.split_summary(split).collect()}
    assert summary["total"]["n"] == 40 and summary["total"]["date_min"] is None
    assert summary["train"]["days_span"] == 25
    audit = {r["split"]: r for r in profile.positive_audit(split).collect()}
    assert audit["train"]["all_positive_in_class"] and audit["train"]["n_positive_cat"] == 4
    none = {r["split"]: r for r in profile.positive_audit(split.withColumn("label", F.lit(0))).collect()}
    assert none["val"]["all_positive_in_class"] and none["val"]["positive_category_value"] is None
    dense = profile.densify(profile.weekday_distribution(split), "weekday")
    assert dense.count() == 21 and dense.where(F.col("n").isNull()).count() > 0
