"""Corpus profile: sizes, categories, drift, lengths, calendar volume, label audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexsieve.functions import fixed
from lexsieve.functions.text import empty_if_null, whitespace_tokens

def _rows():
    return F.count(F.lit(1))


def split_summary(split: DataFrame) -> DataFrame:
    """One row per split and a total row, from one rollup."""
    base = split.rollup("split").agg(
        _rows().alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos_count"),
        F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.count_if(F.col("text").isNull()).alias("n_null_text"), F.grouping("split").alias("g"))
    total = F.max(F.when(F.col("g") == 1, F.col("n"))).over(W.partitionBy())  # four rows
    one = F.col("g") == 0
    return base.select(
        F.when(one, F.col("split")).otherwise("total").alias("split"), "n",
        (F.col("n") / total).alias("share_total"), "pos_count",
        (F.col("pos_count") / F.col("n")).alias("pos_ratio"),
        F.when(one, F.date_format("lo", "yyyy-MM-dd")).alias("date_min"),
        F.when(one, F.date_format("hi", "yyyy-MM-dd")).alias("date_max"),
        F.when(one, F.datediff("hi", "lo") + 1).cast("bigint").alias("days_span"), "n_null_text")


def _category_counts(split: DataFrame) -> DataFrame:
    """Counts per category and split, pivoted, with split totals alongside."""
    counts = split.groupBy("category").pivot("split", list(fixed.SPLITS)).agg(_rows())
    counts = counts.na.fill(0, list(fixed.SPLITS))
    totals = counts.agg(*[F.sum(s).alias(f"_{s}") for s in fixed.SPLITS])  # one row, from the same counts
    counts = counts.join(F.broadcast(totals))
    return counts.where(F.col("category").isNotNull()).withColumn(
        "total_n", sum((F.col(s) for s in fixed.SPLITS), F.lit(0)).cast("bigint"))


def category_distribution(split: DataFrame, top_k: int = 15) -> DataFrame:
    counts = _category_counts(split)
    cols = []
    for s in fixed.SPLITS:
        cols += [F.col(s).alias(f"{s}_n"), (F.col(s) / F.col(f"_{s}")).alias(f"{s}_share")]
    return (counts.select("category", *cols, "total_n")
            .orderBy(F.desc("total_n"), "category").limit(top_k))


def category_drift(split: DataFrame, min_count: int = 500) -> DataFrame:
    counts = _category_counts(split).where(F.col("total_n") >= min_count)
    share = {s: F.col(s) / F.col(f"_{s}") for s in fixed.SPLITS}
    drift = (share["test"] - share["train"]) * 100
    return counts.select(
        "category", "total_n", *[(share[s] * 100).alias(f"{s}_share_pct") for s in fixed.SPLITS],
        drift.alias("drift_test_minus_train_pp"), F.abs(drift).alias("abs_drift"),
    ).orderBy(F.desc("abs_drift"), "category")


def text_length_stats(split: DataFrame, token_clip: int = 2000) -> DataFrame:
    """Exact means and quantiles of lengths.

    ``percentile`` keeps one counter per distinct length, merged map-side, so its state grows with
    the range of lengths and not with the rows.
    """
    lengths = split.select(
        "split", F.length(empty_if_null("title")).alias("ti"), F.length(empty_if_null("text")).alias("te"),
        F.size(whitespace_tokens(empty_if_null("text"))).alias("tk"))
    return lengths.groupBy("split").agg(
        F.avg("ti").alias("title_chars_mean"), F.percentile("ti", F.lit(0.5)).alias("title_chars_median"),
        F.avg("te").alias("text_chars_mean"), F.percentile("te", F.lit(0.5)).alias("text_chars_median"),
        F.percentile("te", F.lit(0.95)).alias("text_chars_p95"),
        F.avg("tk").alias("text_tokens_mean"), F.percentile("tk", F.lit(0.5)).alias("text_tokens_median"),
        F.percentile("tk", F.lit(0.95)).alias("text_tokens_p95"),
        F.percentile(F.least("tk", F.lit(token_clip)), F.lit(0.75)).alias("clipped_tokens_q3"))


def monthly_volume(split: DataFrame) -> DataFrame:
    return split.groupBy("split", F.date_format("date", "yyyy-MM").alias("ym")).agg(
        _rows().alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos"),
        F.avg("label").alias("pos_ratio"))


def densify(per_split: DataFrame, key: str) -> DataFrame:
    """Reindex so that every key seen in any split has a row in every split (nulls where absent)."""
    names = F.array(*[F.lit(s) for s in fixed.SPLITS])
    frame = per_split.select(key).distinct().withColumn("split", F.explode(names))
    return frame.join(per_split, [key, "split"], "left")


def weekday_distribution(split: DataFrame) -> DataFrame:
    """Rows per weekday (Monday is 0) and their share of the split."""
    counts = split.groupBy("split", F.weekday("date").cast("bigint").alias("weekday")).agg(_rows().alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("split")))


def positive_audit(split: DataFrame, positive: str = fixed.POSITIVE_CATEGORY) -> DataFrame:
    """Most frequent category among the positives of each split; pre-counted per category."""
    counts = split.groupBy("split", "category").agg(
        F.sum(F.col("label").cast("bigint")).alias("p"))
    named = (F.col("p") > 0) & F.col("category").isNotNull()
    seen = F.when(named, F.col("p"))
    # most positives first, then the alphabetically first category
    best = F.min(F.when(named, F.struct((-F.col("p")).alias("k"), F.col("category"))))
    return counts.groupBy("split").agg(
        F.sum("p").alias("n_positive"), best["category"].alias("positive_category_value"),
        F.coalesce(F.max(seen), F.lit(0)).cast("bigint").alias("n_positive_cat"),
        F.coalesce(F.bool_and(F.when(F.col("p") > 0, F.coalesce(F.col("category") == positive, F.lit(False)))),
                   F.lit(True)).alias("all_positive_in_class"))
