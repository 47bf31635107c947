"""Word vectors in text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.functions import fixed


def read_vectors(spark: SparkSession, path: str, vocabulary: DataFrame | None = None,
                 dim: int = fixed.EMBEDDING_DIM) -> DataFrame:
    """(token, vec) from lines ``token v1 ... v_dim``; a first line ``count dim`` is checked.

    Lines with fewer values are skipped. Only tokens of ``vocabulary`` (column token) are kept when it
    is given. A token that occurs twice keeps its last line, by position in the file.
    """
    lines = spark.read.text(path)
    head = lines.limit(1).collect()  # the header of the file
    fields = head[0]["value"].split() if head else []
    if len(fields) == 2 and int(fields[1]) != dim:
        raise ValueError(f"vectors have dimension {fields[1]}, expected {dim}")
    parts = F.split("value", " ")
    rows = lines.select(
        parts.alias("p"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                   F.monotonically_increasing_id()).alias("at")).where(F.size("p") >= dim + 1)
    vectors = rows.select(F.col("p")[0].alias("token"), F.slice("p", 2, dim).alias("v"), "at")
    if vocabulary is not None:
        vectors = vectors.join(vocabulary.select("token"), "token", "left_semi")
    last = vectors.groupBy("token").agg(F.max_by("v", "at").alias("v"))
    return last.select("token", F.col("v").cast("array<float>").alias("vec"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(token, vec) as text lines, without a header."""
    line = F.concat_ws(" ", F.col("token"), F.array_join(F.col("vec").cast("array<string>"), " "))
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)
