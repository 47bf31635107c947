"""Bag of words, TF-IDF and averaged embeddings, as long tables and as vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexsieve.functions.text import whitespace_tokens
from lexsieve.operators.vocabulary import TERM_ROW_BYTES, Vocabulary, exploded, term_counts
from lexsieve.plans.scale import BROADCAST_BYTES, global_index, lookup, place_texts, written

MAX_VECTOR_SIZE = 1 << 27  # coefficients of a linear model are held by the driver
#: Vectors and postings of one cell, where averages are added up.
VECTOR_BYTES, CELL_ROWS = 96 << 20, 4 << 20


def bag_of_words(docs: DataFrame, vocabulary: Vocabulary, doc_id: str, carry: tuple[str, ...] = (),
                 text: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """(doc_id, *carry, term_id, value): term counts over the fitted vocabulary."""
    counts = term_counts(docs, vocabulary, doc_id, carry, text, broadcast_bytes)
    return counts.select(doc_id, *carry, "term_id", F.col("n").cast("double").alias("value"))


def tfidf(docs: DataFrame, vocabulary: Vocabulary, doc_id: str, carry: tuple[str, ...] = (),
          text: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """(doc_id, *carry, term_id, value): sublinear tf, smoothed idf, rows scaled to unit length."""
    counts = term_counts(docs, vocabulary, doc_id, carry, text, broadcast_bytes)
    idf = F.log((1.0 + vocabulary.n_docs) / (1.0 + F.col("df"))) + 1.0
    weighted = counts.select(doc_id, *carry, "term_id", ((1.0 + F.log(F.col("n").cast("double"))) * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(doc_id)))  # one document's terms
    return weighted.select(doc_id, *carry, "term_id", (F.col("w") / norm).alias("value"))


def sparse_vectors(docs: DataFrame, long: DataFrame, size: int, doc_id: str,
                   id_col: str = "term_id") -> DataFrame:
    """One sparse ML vector per document of ``docs``; documents without a term get the zero vector.

    The (indices, values) arrays are built by Spark. An identity Arrow UDF only gives the struct the
    vector type, so no number is touched in Python.
    """
    if size > MAX_VECTOR_SIZE:
        raise ValueError(f"{size} columns exceed what a linear model keeps on the driver; raise min_df")
    entries = F.array_sort(F.collect_list(F.struct(F.col(id_col).cast("int").alias("i"), F.col("value").alias("v"))))
    packed = long.groupBy(doc_id).agg(entries.alias("e"))
    joined = docs.join(packed, doc_id, "left")
    empty = F.array().cast("array<struct<i:int,v:double>>")
    e = F.coalesce("e", empty)
    raw = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform(e, lambda x: x["i"]).alias("indices"), F.transform(e, lambda x: x["v"]).alias("values"))
    as_vector = F.arrow_udf(lambda v: v, VectorUDT())
    return joined.withColumn("_raw", raw).withColumn("features", as_vector("_raw")).drop("e", "_raw")


def hashed_terms(long: DataFrame, doc_id: str, size: int) -> DataFrame:
    """Fold the columns of a long feature table into ``size`` hashed columns, sums kept."""
    return (long.withColumn("slot", F.pmod(F.xxhash64("term_id"), F.lit(size)).cast("int"))
            .groupBy(doc_id, "slot").agg(F.sum("value").alias("value")))


def _partial_sums(counts: DataFrame, vectors: DataFrame, postings: int, rows: int, dim: int, doc_id: str) -> DataFrame:
    """(doc_id, weight, sums): weighted sums of vectors by cells, a residue of token ids times a residue of documents.

    A vector travels once to each cell of its tokens and a document leaves one row of sums a cell, so no vector is
    copied to the documents that hold its token. A cell has at most VECTOR_BYTES of vectors and some CELL_ROWS postings.
    """
    parts = -(-rows * 8 * dim // VECTOR_BYTES) or 1
    shares = -(-postings // (parts * CELL_ROWS)) or 1
    part, share = F.pmod("token_id", F.lit(parts)).cast("int").alias("part"), F.pmod(F.xxhash64(doc_id), F.lit(shares)).cast("int").alias("share")
    left = counts.select(part, share, doc_id, "token_id", F.col("n").cast("double").alias("n"))
    right = vectors.select(part, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.col("token_id").alias("own_id"), F.col("v").alias("own_v"))
    kind = counts.schema[doc_id].dataType.simpleString()

    def add(some: pa.Table, own: pa.Table) -> pa.Table:
        ids, flat = own["own_id"].to_numpy(), own["own_v"].combine_chunks().flatten()
        matrix = flat.to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.argsort(ids)
        row = order[np.searchsorted(ids, some["token_id"].to_numpy(), sorter=order)] if len(ids) else np.empty(0, int)
        docs = some[doc_id].combine_chunks().dictionary_encode(null_encoding="encode")
        docs = docs.combine_chunks() if isinstance(docs, pa.ChunkedArray) else docs
        code, n = docs.indices.to_numpy(), some["n"].to_numpy()
        by_doc = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[by_doc], prepend=-1))
        sums, step = np.zeros((len(starts), dim)), max(1, (1 << 22) // dim)
        for at in range(0, len(by_doc), step):  # bounds the products held at once
            here = by_doc[at:at + step]
            first = np.flatnonzero(np.diff(code[here], prepend=-1))
            sums[code[here[first]]] += np.add.reduceat(matrix[row[here]] * n[here, None], first)
        values = pa.array(sums.ravel())
        return pa.table({doc_id: docs.dictionary, "weight": np.bincount(code, n, len(starts)),
                         "sums": pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * dim, pa.int32()), values)})

    return left.groupBy("part", "share").cogroup(right.groupBy("part", "share")).applyInArrow(
        add, f"`{doc_id}` {kind}, weight double, sums array<double>")


def embedding_average(docs: DataFrame, dictionary: DataFrame, dictionary_rows: int, dim: int, doc_id: str,
                      text: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """(doc_id, vector): mean of the vectors of the known whitespace tokens, zeros if none.

    Repeated tokens enter as a weight, so a vector is joined once per distinct token of a document.
    ``dictionary`` is (token, vec) with ``dictionary_rows`` counted rows. Beyond the broadcast limit documents and
    tokens meet by numbers first, and vectors are added up in cells.
    """
    placed = place_texts(docs.select(doc_id, text), doc_id, docs, text)
    tokens = placed.select(doc_id, whitespace_tokens(F.coalesce(text, F.lit(""))).alias("tokens"))
    counts = exploded(tokens, "tokens", "token", doc_id).groupBy(doc_id, "token").agg(F.count(F.lit(1)).alias("n"))
    row_bytes, limit = 16 + 8 * dim, BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if dictionary_rows * row_bytes <= limit:
        vectors = dictionary.select("token", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
        joined = lookup(counts, vectors, "token", table_rows=dictionary_rows, row_bytes=row_bytes, how="inner", broadcast_bytes=limit)
        means = joined.groupBy(doc_id).agg(Summarizer.mean(F.col("v"), F.col("n").cast("double")).alias("m")).select(
            doc_id, vector_to_array("m").alias("a"))
    else:
        counts = written(counts, "token-counts")
        usage = counts.groupBy("token").agg(F.count(F.lit(1)).alias("used"))
        needed = dictionary.select("token", F.col("vec").cast("array<double>").alias("v")).where(F.size("v") == dim).join(usage, "token")
        numbered = global_index(needed, ["token"], "token_id")
        size = numbered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("used"), F.lit(0)).alias("t")).first()
        coded = lookup(counts, numbered.select("token", "token_id", "used"), "token", table_rows=size["n"], row_bytes=TERM_ROW_BYTES,
                       salt_on=doc_id, weight="used", weight_total=size["t"], how="inner", broadcast_bytes=limit)
        sums = _partial_sums(coded, numbered, size["t"], size["n"], dim, doc_id)
        added = sums.groupBy(doc_id).agg(F.sum("weight").alias("w"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
        means = added.select(doc_id, F.array(*[F.col(f"s{i}") / F.col("w") for i in range(dim)]).alias("a"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return docs.select(doc_id).join(means, doc_id, "left").select(doc_id, F.coalesce("a", zeros).alias("vector"))
