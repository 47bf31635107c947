"""Records of CSV files with quoted newlines, where one large file is read by many tasks.

A newline ends a record if an even number of quotes stands before it in its file (a doubled quote counts
twice). So the quotes of each block of a file are counted first; their running sums tell for every block
whether it starts inside a quoted value. With that each task cuts its own block, and only what crosses a
border of blocks is put together by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexsieve.plans.scale import BROADCAST_BYTES, written

#: A broadcast row of the block table: its path, its start and the hash table around it.
BLOCK_ROW_BYTES = 512

_PART = "file string, block bigint, kind string, header boolean, record string"
_WHOLE, _HEAD, _MIDDLE, _TAIL = "whole", "head", "middle", "tail"


class _Cutter:
    """Cuts the lines of one block into records; lines come in order, in batches."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.held: list[str] = []
        self.began = False  # whether the held lines start their record
        self.header = block == 0

    def _rows(self, kind: str, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        header = np.zeros(n, bool)
        header[:1], self.header = self.header, False
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * n), pa.array(np.full(n, self.block)), pa.array([kind] * n), pa.array(header), texts],
            names=["file", "block", "kind", "header", "record"])

    def add(self, lines: pa.Array, quotes: np.ndarray) -> Iterator[pa.RecordBatch]:
        after = (np.cumsum(quotes) + self.inside) % 2
        ends = np.flatnonzero(after == 0) + 1
        done = 0
        if self.inside and len(ends):  # the open record ends here
            done, ends = int(ends[0]), ends[1:]
            text = "\n".join([*self.held, *lines[:done].to_pylist()])
            yield self._rows(_WHOLE if self.began else _HEAD, pa.array([text]))
            self.held = []
        if len(ends):
            offsets = pa.array(np.concatenate([[done], ends]).astype(np.int32))
            yield self._rows(_WHOLE, pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n"))
            done = int(ends[-1])
        if done < len(lines):
            self.began = self.began if self.inside and not done else True
            self.held += lines[done:].to_pylist()
        self.inside = bool(after[-1])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._rows(_TAIL if self.began else _MIDDLE, pa.array(["\n".join(self.held)]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = None
    for batch in batches:
        file, block, value = batch.column("file"), batch.column("block"), batch.column("value").cast(pa.string())
        quotes = batch.column("quotes").to_numpy()
        change = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        borders = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(borders, borders[1:]):
            if a == b:
                continue
            name, start = file[a].as_py(), block[a].as_py()
            if cutter is None or (cutter.file, cutter.block) != (name, start):
                if cutter is not None:
                    yield from cutter.close()
                cutter = _Cutter(name, start, batch.column("inside")[a].as_py())
            yield from cutter.add(value[a:b], quotes[a:b])
    if cutter is not None:
        yield from cutter.close()


def _block_starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether the block starts inside a quoted value; one row a block."""
    counted = written(lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes")), "csv-blocks")
    open_file = counted.groupBy("file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").select("file").first()
    if open_file is not None:
        raise ValueError(f"{open_file['file']} ends inside a quoted value")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _joined_pieces(pieces: DataFrame) -> DataFrame:
    """(header, record) of the records that cross borders. Only keys pass the window of a file, at most two a block."""
    place = (F.col("kind") == _TAIL).cast("int").alias("place")
    keys = pieces.select("file", "block", place)
    so_far = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
    owned = keys.withColumn("owner", F.last(F.when(F.col("place") == 1, F.col("block")), ignorenulls=True).over(so_far))
    together = pieces.select("file", "block", place, "header", "record").join(owned, ["file", "block", "place"])
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "record")))
    return together.groupBy("file", "owner").agg(
        F.max("header").alias("header"),
        F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")).select("header", "record")


def csv_records(spark: SparkSession, path: str, broadcast_bytes: int | None = None) -> DataFrame:
    r"""(header, record): the text of every record below ``path``; ``header`` marks the first one of each file.

    Records end with \n or \r\n, values that hold quotes must be quoted, an escaped quote is doubled. Blank lines
    between records are dropped; empty files and empty folders give no rows. A file that ends inside a quoted
    value raises. A record must fit a task's memory, a block of a file need not.

    The text is read twice, once for the counts. The block table travels to the second scan while its counted rows
    fit ``broadcast_bytes``; beyond it, the lines are shuffled by block. Should the second scan cut files elsewhere
    (the split size follows the cores of the session), it raises instead of guessing.
    """
    value = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.length(value) - F.length(F.translate(value, '"', ""))).alias("quotes"))
    starts = written(_block_starts(lines), "csv-starts")
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if starts.count() * BLOCK_ROW_BYTES <= limit:
        placed = lines.join(F.broadcast(starts), ["file", "block"], "left")
    else:
        numbered = lines.withColumn("line", F.monotonically_increasing_id())
        placed = numbered.join(starts, ["file", "block"], "left").repartition(
            "file", "block").sortWithinPartitions("file", "block", "line")
    known = F.coalesce("inside", F.raise_error(F.concat(
        F.lit("the scans cut files differently, set spark.sql.files.minPartitionNum: "), "file")).cast("boolean"))
    parts = written(placed.select("value", "file", "block", "quotes", known.alias("inside")).mapInArrow(_cut, _PART), "csv-parts")
    whole = parts.where(F.col("kind") == _WHOLE).select("header", "record")
    records = whole.union(_joined_pieces(parts.where(F.col("kind") != _WHOLE)))
    bare = records.select("header", F.regexp_replace("record", "^﻿|\r$", "").alias("record"))
    return bare.where("record <> ''")


def read_csv(spark: SparkSession, path: str, columns: list[str], broadcast_bytes: int | None = None) -> DataFrame:
    """The rows of CSV files with headers as strings, named ``columns``; a record with other than so many values raises.

    Line ends inside quoted values come out as the line feeds that Spark's own reader gives.
    """
    records = csv_records(spark, path, broadcast_bytes).where(~F.col("header"))
    names = [c.replace("`", "``") for c in columns]
    schema = ", ".join(f"`{c}` string" for c in names)
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
    text = F.regexp_replace("record", "\r\n", "\n")
    return records.select(F.from_csv(text, schema, options).alias("r")).select(*[F.col(f"r.`{c}`") for c in names])
