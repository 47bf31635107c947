"""Scoring by a foreign model: an injected client per partition, or an injected batch model."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsieve.functions import fixed
from lexsieve.functions.responses import final_score, hard_prediction, logprob_score, matched_label, score_source

REPLY_FIELDS = (
    T.StructField("raw_text", T.StringType()),
    T.StructField("top_logprobs", T.ArrayType(T.StructType([
        T.StructField("token", T.StringType()), T.StructField("logprob", T.DoubleType())]))),
    T.StructField("latency_s", T.DoubleType()),
)

_REPLY_KINDS = (pa.string(), pa.list_(pa.struct([("token", pa.string()), ("logprob", pa.float64())])), pa.float64())
#: Rows that are Python objects at a time.
REPLY_ROWS = 256


def external_replies(rows: DataFrame, prompt: str, make_client: Callable[[], Callable]) -> DataFrame:
    """Ask the client for each prompt: adds raw_text, top_logprobs, latency_s.

    ``make_client`` runs once per task and returns a callable prompt -> (raw_text, logprobs or
    None, seconds). The number of partitions sets how many clients work at once. Only some rows at a time
    become Python objects, so the memory of a worker does not follow the length of the texts.
    """
    schema = T.StructType([*rows.schema.fields, *REPLY_FIELDS])

    names, kinds = [f.name for f in REPLY_FIELDS], _REPLY_KINDS

    def run(batches: Iterable):
        ask = make_client()
        for whole in batches:
            for at in range(0, whole.num_rows, REPLY_ROWS):
                batch = whole.slice(at, REPLY_ROWS)
                replies = [ask(p) for p in batch.column(prompt).to_pylist()]
                columns = ([r[0] for r in replies],
                           [None if r[1] is None else [{"token": t, "logprob": v} for t, v in r[1]] for r in replies],
                           [r[2] for r in replies])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def score_replies(replies: DataFrame, labels: tuple[str, ...], positive: str) -> DataFrame:
    """Add matched_label, y_pred, y_score and score_source to replies."""
    negatives = tuple(x for x in labels if x != positive)
    staged = (replies.withColumn("matched_label", matched_label("raw_text", labels, positive))
              .withColumn("_lp", logprob_score("top_logprobs", positive, negatives)))
    lp, label = F.col("_lp"), F.col("matched_label")
    return (staged.withColumn("y_pred", hard_prediction(label, positive))
            .withColumn("y_score", final_score(lp, label, positive))
            .withColumn("score_source", score_source(lp, label)).drop("_lp"))


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been scored yet (an anti join never multiplies, so no distinct)."""
    return rows.join(done.select(*keys), keys, "left_anti")


def source_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rows per score source, zero for a source that never occurred, and the processed total."""
    counts = [F.count_if(F.col("score_source") == s).alias(f"n_{s}") for s in fixed.SCORE_SOURCES]
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_processed"), *counts)


def label_counts(scored: DataFrame, labels: tuple[str, ...], by: list[str]) -> DataFrame:
    """Rows per allowed label, zeros included, and the rows without a label."""
    counts = [F.count_if(F.col("matched_label") == x).alias(f"label_{x}") for x in labels]
    return scored.groupBy(*by).agg(*counts, F.count_if(F.col("matched_label").isNull()).alias("label_none"))


def progress(expected: DataFrame, scored: DataFrame, by: str) -> DataFrame:
    """Processed and total rows per split."""
    total = expected.groupBy(by).agg(F.count(F.lit(1)).alias("n_total"))
    done = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n_processed"))
    return total.join(done, by, "left").na.fill(0, ["n_processed"])


def first_rows(split: DataFrame, n: int, index: str = "index") -> DataFrame:
    """Positional head of a split by its explicit row index."""
    return split.where(F.col(index) < n)


def batch_logits(features: Column | str, make_predict: Callable, width: int, batch_size: int = 512) -> Column:
    """Logits per row from an injected batch model, loaded once per Python worker.

    ``make_predict`` returns a function from a (rows, width) array to a (rows, classes) array.
    """
    model = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                              input_tensor_shapes=[[width]])
    return model(features)


def latency_per_1k(scored: DataFrame, by: list[str], seconds: str = "latency_s") -> DataFrame:
    """Milliseconds per thousand rows from stored per-row seconds."""
    return scored.groupBy(*by).agg(
        (F.sum(seconds) * 1e6 / F.count(F.lit(1))).alias("latency_ms_per_1k"))


def timed_latency_per_1k(scored: DataFrame) -> float:
    """Milliseconds per thousand rows of forcing a scoring plan, nothing written."""
    import time

    n = scored.count()
    if n == 0:
        return 0.0
    start = time.perf_counter()
    scored.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - start) * 1000.0 * 1000.0 / n
