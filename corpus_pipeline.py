"""Corpus pipeline: rejects junk, keeps one of each group of near copies, cuts repeated passages, drops documents
that hold benchmark items, and packs what is left into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. Nulls, empty texts, repeated rows and empty tables are treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.llm import decontaminate, forest_join, packing, quality, substring_dedup
from lexsieve.llm.queries import BYTE_BPE, KEEP_CUT, KEEP_GRADE, graded, table
from lexsieve.plans.scale import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are at least fair with a probability of one half."""
    return quality.select_quality(docs, quality.train_ordinal(docs, graded(spark, sf_dir)), KEEP_GRADE, KEEP_CUT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of near copies."""
    return forest_join.one_of_each_class(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words of repeated windows; n_chars follows the text."""
    return substring_dedup.without_repeats(docs).withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), conflicts="cut")


#: Less than the encoder's own bounds: as a stage, packing shares workers with what ran before.
PACK_CHUNKS, PACK_SLICE = 200_000, (1 << 18) - 1


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and offset of each piece of each document."""
    return packing.packed_sequences(docs, BYTE_BPE, end_id=0, cache=PACK_CHUNKS, slice_bytes=PACK_SLICE)


STAGES = [
    ("ordinal quality", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Trained scores, hashed signatures and tokenizers have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
