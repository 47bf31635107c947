"""Statistic and p-value of the paired McNemar test as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexsieve.functions import fixed


def _complementary_error():
    """Arrow UDF for erfc, which Spark lacks; it sees one row per compared pair."""
    @F.pandas_udf("double")
    def erfc(x: pd.Series) -> pd.Series:
        import math

        return x.map(math.erfc, na_action="ignore")

    return erfc


def mcnemar_statistic(b: Column, c: Column, exact_below: int = fixed.MCNEMAR_EXACT_BELOW) -> Column:
    """0 without disagreement, the smaller count for few, else the corrected chi-square."""
    n = b + c
    gap = F.abs(b - c) - 1
    return (F.when(n == 0, F.lit(0.0))
            .when(n < exact_below, F.least(b, c).cast("double"))
            .otherwise((gap * gap) / n))


def exact_binomial_p(b: Column, c: Column) -> Column:
    """Two-sided binomial p at one half: twice the lower tail, at most 1."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def add(acc, i):  # term holds C(n, i)
        return F.struct(
            (acc["term"] * (n - i) / (i + F.lit(1.0))).alias("term"),
            (acc["total"] + acc["term"]).alias("total"))

    tail = F.aggregate(F.sequence(F.lit(0), k), start, add, lambda acc: acc["total"])
    return F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))


def mcnemar_p(b: Column, c: Column, exact_below: int = fixed.MCNEMAR_EXACT_BELOW) -> Column:
    n = b + c
    chi = F.when(n >= exact_below, F.sqrt(mcnemar_statistic(b, c, exact_below) / 2))
    few = n < exact_below
    exact = exact_binomial_p(F.when(few, b).otherwise(0), F.when(few, c).otherwise(0))
    return F.when(n == 0, F.lit(1.0)).when(few, exact).otherwise(_complementary_error()(chi))
