"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

File format, a folder of parquet tables written and committed by Spark tasks:

* ``blocks``: documents in ascending id order. A block holds whole documents: `part` and `block` (their order is
  the order of the documents), `before` (ids of the part ahead of the block), `doc_ids`, `lengths` (ids of each document), and two byte strings. `control` has
  two bits for each id, four ids to a byte, the first in the low bits: the number of data bytes less one. `data`
  has the ranks of the ids, little-endian, one to four bytes each.
* ``ranks``: id of each rank, most frequent first (ties: the smaller id), so that the 256 most frequent ids take
  one byte.
* ``parts``: ids in each part, from which readers get global starts without moving blocks.

Decoding needs no loop over ids: a table of the four lengths of each control byte gives the byte offset of every
id by a running sum, and the ranks are gathered from there.

Edge cases: null texts are empty and consist of the end id alone; rows with a null id come first; rows of equal
id are ordered by number of ids and checksum; an empty table gives empty tables; extra columns are ignored; a text longer
than a block is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.llm import rolling, token_encode
from lexsieve.plans.scale import partitions, spread, written

BLOCK_IDS = 1 << 16
#: Ids of a range partition of the store, about.
PART_IDS = 1 << 23

_LENGTHS = np.array([[(b >> s & 3) + 1 for s in (0, 2, 4, 6)] for b in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of a sequence of ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    ranks = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        ranks[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def id_type(vocabulary: str) -> str:
    """Little-endian unsigned type that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def encoded_documents(documents: DataFrame, vocabulary: str, folds: bool, end_id: int) -> DataFrame:
    """(doc_id, n_ids, ids) of (doc_id, text); ids as bytes of the vocabulary's id type, with the end id."""
    kind = id_type(vocabulary)
    wide = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = token_encode.encoder(vocabulary, folds), np.array([end_id], kind).tobytes()
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text", token_encode.SLICE_BYTES):
                ids, bounds = tokens.encode(data, offsets)
                raw = ids.astype(kind).tobytes()
                rows = [raw[wide * a:wide * b] + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds) + 1), pa.array(rows, pa.binary())], ["doc_id", "n_ids", "ids"])

    return documents.mapInArrow(encode, "doc_id long, n_ids long, ids binary")


def frequency_ranks(encoded: DataFrame, kind: str) -> DataFrame:
    """(rank, id) of all ids that occur."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            found = np.bincount(ids)
            if len(found) > len(total):
                total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
            total[:len(found)] += found
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = counts.toArrow().sort_by([("n", "descending"), ("id", "ascending")])  # as many rows as the vocabulary at most
    rank = np.arange(len(table))
    return encoded.sparkSession.createDataFrame(pa.table({"rank": rank, "id": table["id"]}))


def ordered_blocks(encoded: DataFrame, ranks: DataFrame, kind: str) -> DataFrame:
    """Blocks of the store from encoded documents."""
    spark = encoded.sparkSession
    own = ranks.toArrow().sort_by("rank")["id"].to_numpy()
    rank_of = np.zeros(int(own.max()) + 1 if len(own) else 1, np.uint32)
    rank_of[own] = np.arange(len(own))
    shared = spark.sparkContext.broadcast(rank_of)
    total = encoded.agg(F.sum("n_ids")).first()[0] or 0
    n = max(partitions(spark), -(-total // PART_IDS))
    order = ["doc_id", "n_ids", "sum"]
    dealt = encoded.withColumn("sum", F.crc32("ids")).repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "doc_id", "n_ids", "ids")

    def block(part: int, number: int, before: int, docs: list, sizes: list, raw: list) -> pa.RecordBatch:
        control, data = encode_ranks(shared.value[np.frombuffer(b"".join(raw), kind)])
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
             pa.array([sizes], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
            ["part", "block", "before", "doc_ids", "lengths", "control", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, docs, sizes, raw, held = 0, 0, 0, [], [], [], 0
        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            for doc, size, ids in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if held and held + size > BLOCK_IDS:
                    yield block(part, number, before, docs, sizes, raw)
                    number, before, docs, sizes, raw, held = number + 1, before + held, [], [], [], 0
                docs.append(doc), sizes.append(size), raw.append(ids)
                held += size
        if docs:
            yield block(part, number, before, docs, sizes, raw)

    return dealt.mapInArrow(write, "part int, block int, before long, doc_ids array<long>, lengths array<long>, control binary, data binary")


def write_store(documents: DataFrame, path: str, vocabulary: str, *, folds: bool, end_id: int, key: str = "doc_id",
                text: str = "text") -> None:
    """Encode every document and write the store below path."""
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    encoded = written(encoded_documents(spread(texts), vocabulary, folds, end_id), "ids")
    kind = id_type(vocabulary)
    ranks = frequency_ranks(encoded, kind)
    ranks.write.parquet(f"{path}/ranks")
    blocks = ordered_blocks(encoded, ranks, kind)
    blocks.write.parquet(f"{path}/blocks")
    sizes = encoded.sparkSession.read.schema(blocks.schema).parquet(f"{path}/blocks").select("part", "lengths")
    sizes.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids")).write.parquet(f"{path}/parts")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    ranks = spark.read.parquet(f"{path}/ranks").toArrow().sort_by("rank")["id"].to_numpy()
    id_of = spark.sparkContext.broadcast(ranks.astype("<u4"))
    by_part = spark.read.parquet(f"{path}/parts").toArrow().sort_by("part")  # one row for each part
    ahead = np.cumsum(by_part["ids"].to_numpy()) - by_part["ids"].to_numpy() if len(by_part) else np.zeros(0, np.int64)
    offsets = spark.createDataFrame(pa.table({"part": by_part["part"].cast(pa.int32()), "ahead": ahead}))
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(offsets), "part").select(
        (F.col("ahead") + F.col("before")).alias("start"), "doc_ids", "lengths", "control", "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, docs, sizes_, control, data = (batch.column(c)[k].as_py() for c in range(5))
                size = np.array(sizes_, np.int64)
                ids = id_of.value[decode_ranks(control, data, int(size.sum()))]
                bounds = np.concatenate(([0], np.cumsum(size)))
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + bounds[:-1]), pa.array(size), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
