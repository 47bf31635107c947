"""Chronological out-of-time split: ties on a boundary date stay in the older part."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.functions import fixed
from lexsieve.plans.scale import global_index


@dataclass(frozen=True)
class SplitBounds:
    """Last date of train and last date of val; later rows are test."""

    train_end: Any
    val_end: Any
    n_rows: int

    def column(self, date: str = "date") -> Column:
        d = F.col(date)
        return (F.when(d <= F.lit(self.train_end), "train")
                .when(d <= F.lit(self.val_end), "val").otherwise("test"))

    def part(self, df: DataFrame, split: str, date: str = "date") -> DataFrame:
        """One split alone, as a plain date range that reaches the scan."""
        d = F.col(date)
        ranges = {"train": d <= F.lit(self.train_end), "test": d > F.lit(self.val_end),
                  "val": (d > F.lit(self.train_end)) & (d <= F.lit(self.val_end))}
        return df.where(ranges[split]).withColumn("split", F.lit(split))


def _check_fractions(train: float, val: float) -> None:
    if not 0 < train < 1 or not 0 < val < 1:
        raise ValueError(f"fractions must lie in (0, 1), got {train} and {val}")
    if train + val >= 1:
        raise ValueError(f"train + val must stay below 1, got {train + val}")


def _value_at(df: DataFrame, date: str, day: Any, skip: int) -> Any:
    """Date value at position ``skip`` of one day, by second, then by exact value in that second.

    Each step counts at most 86,400 seconds or 1,000,000 microseconds, whatever the row count.
    """
    in_day = df.where((F.col(date) >= F.lit(day).cast(df.schema[date].dataType))
                      & (F.to_date(date) == F.lit(day)))
    second = F.date_trunc("second", F.col(date))
    for key in (second, F.col(date)):
        rows = sorted((r[0], r[1]) for r in
                      in_day.groupBy(key.alias("k")).agg(F.count(F.lit(1))).collect())
        for value, n in rows:
            if skip < n:
                break
            skip -= n
        in_day = in_day.where(key == F.lit(value))
    return value


def split_bounds(df: DataFrame, train: float = 0.80, val: float = 0.10, date: str = "date",
                 label: str = "label", check: bool = True) -> SplitBounds:
    """Boundary dates of the split, from one count per calendar day.

    No sort of the rows: only (day, counts) pairs reach the driver, bounded by the calendar. Days
    with several time stamps are refined by further bounded counts.
    """
    _check_fractions(train, val)
    days = df.groupBy(F.to_date(date).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last"),
        F.sum(label).alias("pos"))
    rows = sorted(days.collect(), key=lambda r: (r["day"] is not None, r["day"]))
    if rows and rows[0]["day"] is None:
        raise ValueError(f"{rows[0]['n']} rows have no date")
    n = sum(r["n"] for r in rows)
    if n < 3:
        raise ValueError(f"at least 3 rows are needed for a split, got {n}")

    def at(position: int) -> Any:
        for r in rows:
            if position < r["n"]:
                return r["last"] if r["first"] == r["last"] else _value_at(df, date, r["day"], position)
            position -= r["n"]
        raise AssertionError("position beyond the last row")

    bounds = SplitBounds(at(int(n * train)), at(int(n * (train + val))), n)
    if check:
        whole_days = all(r["first"] == r["last"] for r in rows)
        if whole_days:
            parts: dict[str, list] = {name: [] for name in fixed.SPLITS}
            for r in rows:
                late = "val" if r["last"] <= bounds.val_end else "test"
                parts["train" if r["last"] <= bounds.train_end else late].append(r)
            stats = {name: (sum(r["n"] for r in p), sum(r["pos"] or 0 for r in p))
                     for name, p in parts.items()}
        else:
            got = df.groupBy(bounds.column(date).alias("s")).agg(
                F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")).collect()
            stats = {r["s"]: (r["n"], r["pos"] or 0) for r in got}
        for name in fixed.SPLITS:
            size, positives = stats.get(name, (0, 0))
            if not size:
                raise ValueError(f"split {name!r} is empty: too few distinct dates")
            if not positives:
                raise ValueError(f"split {name!r} has no positive row")
    return bounds


def split_out_of_time(df: DataFrame, train: float = 0.80, val: float = 0.10, date: str = "date",
                      label: str = "label", check: bool = True) -> DataFrame:
    """Add the column ``split``; the rows themselves are never shuffled."""
    return df.withColumn("split", split_bounds(df, train, val, date, label, check).column(date))


def split_invariants(split: DataFrame, date: str = "date", label: str = "label") -> DataFrame:
    """One row per split with the figures the invariants are about, and the verdicts."""
    stats = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("date_min"), F.max(date).alias("date_max"),
        F.sum(F.col(label).cast("bigint")).alias("pos_count"))
    prior = {"val": "train", "test": "val"}
    earlier = stats.select(F.col("split").alias("p"), F.col("date_max").alias("prior_max"))
    before = F.when(F.col("split") == "val", prior["val"]).when(F.col("split") == "test", prior["test"])
    return (stats.join(earlier, before == F.col("p"), "left")
            .select("split", "n", "pos_count",
                    (F.col("n") > 0).alias("non_empty"), (F.col("pos_count") > 0).alias("has_positive"),
                    F.coalesce(F.col("date_min") > F.col("prior_max"), F.lit(True)).alias("after_prior")))


def describe_split(split: DataFrame, date: str = "date", label: str = "label") -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("window_start"), F.max(date).alias("window_end"),
        F.sum(F.col(label).cast("bigint")).alias("pos_count"),
        F.round(F.avg(label), 6).alias("pos_ratio"))


def split_windows(split: DataFrame, date: str = "date") -> DataFrame:
    return split.groupBy("split").agg(
        F.date_format(F.min(date), "yyyy-MM-dd").alias("window_start"),
        F.date_format(F.max(date), "yyyy-MM-dd").alias("window_end"), F.count(F.lit(1)).alias("n"))


def split_row_index(split: DataFrame, order: tuple[str, ...] = ("date", "link")) -> DataFrame:
    """Add ``index``, the 0-based position of a row within its split.

    Splits are contiguous in date order, so one global numbering minus the first number of each of
    the three splits is enough; no window over a whole split.
    """
    numbered = global_index(split, list(order), "_row")
    first = numbered.groupBy("split").agg(F.min("_row").alias("_first"))  # three rows
    return (numbered.join(F.broadcast(first), "split")
            .withColumn("index", F.col("_row") - F.col("_first")).drop("_row", "_first"))
