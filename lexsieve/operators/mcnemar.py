"""Paired comparison of runs on the rows both have predicted.

Outcomes travel as bits. The rows are numbered inside hash parts; a word holds 64 rows of one run in three masks: which rows
it predicted, where it is right, where the truth is 1. A pair of runs is compared by AND and bit counts of
its words. The unit of work is a chunk of rows with two groups of runs and the pairs asked for between them; only
counts per pair and chunk leave it. Neither the number of runs nor that of pairs is limited, none is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexsieve.functions import fixed
from lexsieve.functions.pvalues import mcnemar_p, mcnemar_statistic
from lexsieve.plans.scale import global_index, lookup, written

#: Runs of one group, words of one chunk (64 rows each) and predictions of one part of the row numbering.
GROUP_RUNS, CHUNK_WORDS, PART_PREDICTIONS = 128, 2048, 1 << 22
#: Words of compared pairs that are held at once.
_HELD_WORDS = 1 << 20
_MASKS = ("known", "correct", "truth")


def outcome_words(predictions: DataFrame, numbered: DataFrame, index: str = "index") -> DataFrame:
    """(chunk_part, chunk, word, no, known, correct, truth) from predictions of the numbered runs (run_id, no).

    A run predicts a row once; an equal repeat changes nothing. Rows without truth or prediction take no part.
    """
    present = predictions.where("y_true is not null and y_pred is not null")
    own = lookup(present, numbered, "run_id", table_rows=numbered.count(), how="inner").select(index, "no", "y_true", "y_pred")
    own = written(own, "predicted")  # evaluated once, then counted
    parts = max(predictions.sparkSession.sparkContext.defaultParallelism, -(-own.count() // PART_PREDICTIONS))
    place = F.dense_rank().over(W.partitionBy("chunk_part").orderBy(index)) - 1  # a part is bounded by PART_PREDICTIONS on average
    bits = own.select(F.pmod(F.xxhash64(index), F.lit(parts)).alias("chunk_part"), index, "no",
                      F.col("y_true").cast("int").alias("t"), F.col("y_pred").cast("int").alias("p")).withColumn("place", place)
    bit = F.expr("shiftleft(1L, place % 64)")
    zero = F.lit(0).cast("long")
    word = F.floor(F.col("place") / 64)
    return bits.groupBy("chunk_part", F.floor(word / CHUNK_WORDS).alias("chunk"), F.pmod(word, F.lit(CHUNK_WORDS)).alias("word"), "no").agg(
        F.bit_or(bit).alias("known"),
        F.bit_or(F.when(F.col("t") == F.col("p"), bit).otherwise(zero)).alias("correct"),
        F.bit_or(F.when(F.col("t") == 1, bit).otherwise(zero)).alias("truth"))


def _counted(words: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """n_rows, b, c and conflicts of each pair in one chunk of rows."""
    names, row = np.unique(words["no"].to_numpy(), return_inverse=True)
    used, column = np.unique(words["word"].to_numpy(), return_inverse=True)
    masks = {m: np.zeros((len(names), len(used)), np.uint64) for m in _MASKS}
    for m, table in masks.items():
        table[row, column] = words[m].to_numpy(np.int64).view(np.uint64)
    known, correct, truth = (masks[m] for m in _MASKS)
    pairs = pairs[pairs["no_a"].isin(names) & pairs["no_b"].isin(names)]
    a, b = (np.searchsorted(names, pairs[c].to_numpy()) for c in ("no_a", "no_b"))
    counts = np.zeros((len(pairs), 4), np.int64)
    step = max(1, _HELD_WORDS // max(1, len(used)))
    for i in range(0, len(pairs), step):
        x, y = a[i:i + step], b[i:i + step]
        both = known[x] & known[y]
        for k, mask in enumerate((both, both & correct[x] & ~correct[y], both & ~correct[x] & correct[y], both & (truth[x] ^ truth[y]))):
            counts[i:i + step, k] = np.bitwise_count(mask).sum(axis=1)
    out = pd.DataFrame(counts, columns=["n_rows", "b", "c", "conflicts"])
    out.insert(0, "no_a", pairs["no_a"].to_numpy())
    out.insert(1, "no_b", pairs["no_b"].to_numpy())
    return out[out["n_rows"] > 0]


def pair_counts(words: DataFrame, coded: DataFrame) -> DataFrame:
    """(no_a, no_b, n_rows, b, c, conflicts) of the coded pairs (no_a, no_b) that share a row."""
    group = lambda c: F.floor(F.col(c) / GROUP_RUNS)
    coded = coded.withColumns({"ga": group("no_a"), "gb": group("no_b")})
    units = coded.select("ga", "gb").distinct()
    roles = written(units.withColumn("g", F.explode(F.array_distinct(F.array("ga", "gb")))), "roles")
    dealt = lookup(words.withColumn("g", group("no")), roles, "g", table_rows=roles.count(), how="inner")
    keys = ["chunk_part", "chunk", "ga", "gb"]
    # every unit gets its own copy of the pairs asked for; beyond the broadcast limit they have many group keys
    asked = lookup(dealt.select(*keys).distinct(), coded, ["ga", "gb"], table_rows=coded.count(), how="inner").select(
        *[F.col(k).alias(f"{k}_asked") for k in keys], "no_a", "no_b")
    parts = dealt.groupBy(*keys).cogroup(asked.groupBy(*[f"{k}_asked" for k in keys])).applyInPandas(
        _counted, "no_a long, no_b long, n_rows long, b long, c long, conflicts long")
    return parts.groupBy("no_a", "no_b").agg(*[F.sum(c).alias(c) for c in ("n_rows", "b", "c", "conflicts")])


def compare_pairs(predictions: DataFrame, pairs: DataFrame, index: str = "index",
                  keep_empty: bool = False) -> DataFrame:
    """b, c, statistic, p-value and winner for each (run_a, run_b) of ``pairs``; no pairs give an empty table.

    A pair whose runs disagree on the true label of a row raises. Pairs without a common row are left out unless
    ``keep_empty``.
    """
    listed = pairs.select("run_a", "run_b").distinct()
    numbered = global_index(listed.select(F.explode(F.array("run_a", "run_b")).alias("run_id")).distinct().where("run_id is not null"),
                            ["run_id"], "no")
    side = lambda s: numbered.select(F.col("run_id").alias(f"run_{s}"), F.col("no").alias(f"no_{s}"))
    coded = written(listed.join(side("a"), "run_a").join(side("b"), "run_b"), "pairs")
    words = written(outcome_words(predictions, numbered, index), "outcomes")
    counts = coded.join(pair_counts(words, coded.select("no_a", "no_b")), ["no_a", "no_b"]).drop("no_a", "no_b")
    result = (pairs.join(counts, ["run_a", "run_b"], "left" if keep_empty else "inner"))
    guard = F.when(F.col("conflicts") > 0, F.raise_error(F.concat(
        F.lit("true labels differ between "), "run_a", F.lit(" and "), "run_b")).cast("bigint"))
    return (result.withColumn("b", F.coalesce(guard, F.col("b"))).drop("conflicts")
            .withColumn("statistic", mcnemar_statistic(F.col("b"), F.col("c")))
            .withColumn("p_value", mcnemar_p(F.col("b"), F.col("c")))
            .withColumn("significant", F.col("p_value") < fixed.SIGNIFICANCE))


def winner(name_a: str | Column, name_b: str | Column) -> Column:
    """Which side is right more often where only one is; tie when equal."""
    a = name_a if isinstance(name_a, Column) else F.lit(name_a)
    b = name_b if isinstance(name_b, Column) else F.lit(name_b)
    return F.when(F.col("c") > F.col("b"), b).when(F.col("b") > F.col("c"), a).otherwise("tie")


def run_pairs(runs: DataFrame) -> DataFrame:
    """Every unordered pair of runs (run_a < run_b), from the registry, not from predictions; none for fewer than two runs."""
    ids = global_index(runs.select("run_id").where("run_id is not null").distinct(), ["run_id"], "no")
    last = ids.agg(F.max("no").alias("last")).first()["last"] or 0
    first = ids.where(F.col("no") < last).select(F.col("run_id").alias("run_a"), F.explode(
        F.sequence(F.col("no") + 1, F.lit(last).cast("long"))).alias("no"))
    return first.join(ids.withColumnRenamed("run_id", "run_b"), "no").select("run_a", "run_b")


def mcnemar_columns(y_true: str, y_a: str, y_b: str) -> dict[str, Column]:
    """b and c as aggregates over one table holding both predictions."""
    t, a, b = F.col(y_true), F.col(y_a), F.col(y_b)
    return {"b": F.count_if((a == t) & (b != t)), "c": F.count_if((a != t) & (b == t))}


def mcnemar(df: DataFrame, by: list[str], y_true: str = "y_true", y_a: str = "y_a", y_b: str = "y_b") -> DataFrame:
    counts = df.groupBy(*by).agg(*[v.alias(k) for k, v in mcnemar_columns(y_true, y_a, y_b).items()])
    return (counts.withColumn("statistic", mcnemar_statistic(F.col("b"), F.col("c")))
            .withColumn("p_value", mcnemar_p(F.col("b"), F.col("c"))))
