"""Resumable scoring of an append-only table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexsieve.operators.scoring import pending


def score_and_append(rows: DataFrame, path: str, keys: list[str], score: Callable[[DataFrame], DataFrame],
                     schema: T.StructType) -> None:
    """Score the rows whose key is not in the table at ``path`` yet and append them.

    Stopping and starting again continues with the rest; a batch that is replayed adds nothing, a key that a batch
    holds twice is scored once.
    """
    spark = rows.sparkSession
    try:
        done = spark.read.schema(schema).parquet(path)
    except Exception as e:  # first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], schema)
    score(pending(rows, done, keys).dropDuplicates(keys)).select(*schema.fieldNames()).write.mode("append").parquet(path)


def score_stream(spark: SparkSession, source: str, source_schema: T.StructType, path: str, checkpoint: str,
                 keys: list[str], score: Callable[[DataFrame], DataFrame], schema: T.StructType):
    """Score all files that arrived since the last call, then stop.

    Progress lives in ``checkpoint``; the keyed append makes a repeated micro-batch harmless.
    """
    arrived = spark.readStream.schema(source_schema).parquet(source)
    return (arrived.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, _: score_and_append(batch, path, keys, score, schema)).start())
