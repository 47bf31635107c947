"""Corpus ingestion: CSV to typed parquet, loading, split tables, content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsieve.functions import fixed
from lexsieve.functions.labels import binary_label
from lexsieve.sources.csv_records import read_csv


def read_corpus_csv(spark: SparkSession, path: str, date_format: str | None = None) -> DataFrame:
    """Typed rows of a quoted CSV with a header; ``subcategory`` is dropped.

    Column names come from the header of the first file, types are never inferred. Malformed records and dates
    raise. Quoted newlines may stand anywhere: ``csv_records`` finds the records of a block by its quotes.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    header = spark.read.options(**options).csv(path).columns  # reads one record
    missing = [c for c in fixed.CSV_REQUIRED_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    raw = read_csv(spark, path, header)
    value = {c: F.when(~F.col(c).isin(*fixed.CSV_MISSING), F.col(c)) for c in fixed.CSV_REQUIRED_COLUMNS}
    parse = F.to_timestamp_ntz(value["date"], F.lit(date_format)) if date_format else value["date"].cast("timestamp_ntz")
    columns = {**value, "date": parse}
    return raw.select(*[columns[c].alias(c) for c in fixed.CSV_REQUIRED_COLUMNS])


def convert_csv(spark: SparkSession, csv_path: str, parquet_path: str, positive: str = fixed.POSITIVE_CATEGORY,
                date_format: str | None = None) -> DataFrame:
    """CSV to zstd parquet in (date, link) order, and a one-row summary of what was written."""
    rows = read_corpus_csv(spark, csv_path, date_format)
    (rows.repartitionByRange("date", "link").sortWithinPartitions("date", "link")
     .write.mode("overwrite").option("compression", "zstd").parquet(parquet_path))
    return corpus_summary(spark.read.schema(rows.schema).parquet(parquet_path), positive)


def corpus_summary(rows: DataFrame, positive: str = fixed.POSITIVE_CATEGORY) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.count_if(F.col("category") == positive).alias("n_positive"))


def with_label(rows: DataFrame, positive: str = fixed.POSITIVE_CATEGORY) -> DataFrame:
    """Check the date type, derive the label, fix the column order. Sorting is left to the sinks."""
    missing = [c for c in fixed.CORPUS_COLUMNS if c != "label" and c not in rows.columns]
    if missing:
        raise ValueError(f"corpus lacks the columns {missing}")
    kind = rows.schema["date"].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise TypeError(f"date must be a date or timestamp, got {kind.simpleString()}")
    return rows.withColumn("label", binary_label("category", positive)).select(*fixed.CORPUS_COLUMNS)


def load_corpus(spark: SparkSession, root: str, pattern: str = "*.parquet",
                positive: str = fixed.POSITIVE_CATEGORY) -> DataFrame:
    """All corpus parquet files below ``root`` whose name matches ``pattern``."""
    return with_label(spark.read.option("pathGlobFilter", pattern).parquet(root), positive)


def write_splits(split: DataFrame, path: str) -> None:
    """One folder per split; files are sorted by (date, link) and hold disjoint ranges of it.

    Ranging on (split, date, link) lets each task write one or two folders and spreads a large split
    over many tasks.
    """
    order = ["split", "date", "link"]
    (split.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def row_digest(columns: list[str]) -> Column:
    """First 60 bits of the SHA-256 of a row; nulls and empty strings differ."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    hexes = F.substring(F.sha2(F.concat_ws("\x1f", *cells), 256), 1, 15)
    return F.conv(hexes, 16, 10).cast("bigint")


def content_digest(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count and order-free content digest; equal rows add up instead of cancelling."""
    columns = [c for c in rows.columns if c not in (by or [])]
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(row_digest(columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes; one file is one row, so files must stay below 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_report(table: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A report as one CSV file with a header; reports are a few rows per run.

    Rows are sorted by ``order``; by default by whichever of the columns that name a run the report has.
    """
    keys = [c for c in fixed.REPORT_ORDER if c in table.columns] if order is None else order
    rows = table.repartition(1)
    (rows.sortWithinPartitions(*keys) if keys else rows).write.mode("overwrite").option("header", True).csv(path)
