"""Decision metrics at a fixed cut, for any number of runs in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def check_binary(df: DataFrame, *columns: str, score: str | None = None) -> None:
    """Raise unless the frame is non-empty, the columns hold 0/1 and the score is a number."""
    bad = [F.count_if(F.col(c).isNull() | ~F.col(c).isin(0, 1)).alias(c) for c in columns]
    if score:
        bad.append(F.count_if(F.col(score).isNull() | F.isnan(score)).alias(score))
    row = df.agg(F.count(F.lit(1)).alias("_n"), *bad).first()
    if row["_n"] == 0:
        raise ValueError("no rows to evaluate")
    for name in [*columns, *([score] if score else [])]:
        if row[name]:
            raise ValueError(f"{row[name]} rows have an invalid {name}")


def not_binary(c: Column) -> Column:
    return c.isNull() | ~c.isin(0, 1)


def unless_bad(count: Column | str, value: Column | str, what: str) -> Column:
    """A count, or an error when rows outside 0/1 were counted in the same aggregate."""
    count, value = (F.col(c) if isinstance(c, str) else c for c in (count, value))
    return F.when(count == 0, value).otherwise(F.raise_error(F.lit(f"{what} must be 0 or 1 in every row")).cast("long"))


def confusion(df: DataFrame, by: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Confusion cells of each group; a label or a prediction outside 0/1 raises."""
    t, p = F.col(y_true), F.col(y_pred)
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    counted = df.groupBy(*by).agg(
        *[F.count_if((t == a) & (p == b)).alias(name) for name, (a, b) in cells.items()],
        F.count_if(not_binary(t) | not_binary(p)).alias("_bad"))
    return counted.select(*by, *[unless_bad("_bad", name, "labels and predictions").alias(name) for name in cells])


def f1_positive(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def f1_macro(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Mean F1 over the classes that occur in truth or prediction."""
    pos, neg = f1_positive(tp, fp, fn), f1_positive(tn, fn, fp)
    has_pos, has_neg = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    return F.when(has_pos & has_neg, (neg + pos) / 2).when(has_pos, pos).otherwise(neg)


def decision_metrics(df: DataFrame, by: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df, by, y_true, y_pred).select(
        *by, "tn", "fp", "fn", "tp",
        ratio(tp, tp + fp).alias("precision_minority"), ratio(tp, tp + fn).alias("recall_minority"),
        f1_positive(tp, fp, fn).alias("f1_minority"), f1_macro(tn, fp, fn, tp).alias("f1_macro"))
