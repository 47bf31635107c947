"""Building blocks that keep plans distributed: durable tables, global order, safe lookups.

Size rules used by the whole library:

* a table is broadcast only after its rows were counted against a limit;
* a global order never runs through one task: rows are range-partitioned, numbered locally and
  shifted by per-partition offsets;
* keys that hold a large share of the rows are salted.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 256 * 1024 * 1024
HOT_KEYS = 1000
#: Text of one partition whose documents are taken apart into terms, some hundred bytes of working memory a term.
TEXT_BYTES = 4 << 20
SALTS = 64


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates, as the session names it.

    A session that names none gets a temporary folder only where driver and executors are one process
    (master ``local``); on a cluster such a folder would lose rows silently, so this raises instead. The
    session's own settings are never changed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="lexsieve-")
    return _LOCAL_FOLDERS[context.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes the rows once and survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Unlike a checkpoint the result keeps column pruning and filter pushdown, so it suits wide
    tables that several jobs read.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A driver-side table of a few rows, planned as literal rows without a job."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute a scan that arrives in fewer partitions than there are cores.

    Meant for plain scans right after reading: a file with one row group is one task otherwise. A
    large table already has many partitions and is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def place_texts(docs: DataFrame, key: str, measured: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` by hash of ``key`` in partitions of about TEXT_BYTES of the texts in ``measured``.

    The texts are measured in a pass of their own. The count is explicit, so that adaptive execution does not join
    partitions by their size before the documents are taken apart: the memory of a task does not grow with the input.
    """
    total = measured.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(max(cores, -(-total // TEXT_BYTES)), key)


def global_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """0-based position of each row in the total order ``order``.

    Range partitioning spreads any one leading value (a hot date) over many partitions as long as
    later keys differ. The laid-out rows are written once, because the offsets must describe the very
    rows they are added to. Only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    local = (
        df.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    rows = written(local, "index")
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    parts, offsets, total = [], [], 0
    for part, n in counts:
        parts.append(part)
        offsets.append(total)
        total += n
    if not parts:
        return rows.select(*df.columns, F.lit(0).cast("bigint").alias(name))
    table = local_table(spark, _p=parts, _offset=offsets)  # one row per partition
    return rows.join(F.broadcast(table), F.col("_part") == F.col("_p")).select(
        *df.columns, (F.col("_offset") + F.col("_pos")).alias(name))


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], *, table_rows: int, row_bytes: int = 64,
           salt_on: str | None = None, weight: str | None = None, weight_total: int | None = None,
           how: str = "left", broadcast_bytes: int | None = None) -> DataFrame:
    """Join ``rows`` to a table unique on ``key``.

    ``table_rows`` is the counted size of the table. Within the limit it is broadcast and the
    partitioning of ``rows`` survives. Beyond it both sides are shuffled; keys whose ``weight``
    (number of matching rows) is a large share of ``weight_total`` are spread over SALTS partitions.
    At most HOT_KEYS keys can exceed ``weight_total / HOT_KEYS``, so the list of hot keys that is
    broadcast for this is bounded by construction.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if table_rows * row_bytes <= limit:
        return rows.join(F.broadcast(table), key, how)
    if salt_on is None:
        return rows.join(table, key, how)
    if weight is None or weight_total is None:
        salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)).cast("int"))
    else:
        is_hot = F.col(weight) > F.lit(weight_total / HOT_KEYS)
        no_key = reduce(or_, [F.col(k).isNull() for k in ([key] if isinstance(key, str) else key)])  # matches nothing
        hot = table.where(is_hot).select(key, F.lit(True).alias("_hot"))
        salted_table = table.withColumn("_salt", F.explode(
            F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn(
            "_salt",
            F.when(F.col("_hot") | no_key, F.pmod(F.xxhash64(salt_on), F.lit(SALTS)).cast("int")).otherwise(0),
        ).drop("_hot")
    return salted_rows.join(salted_table, [key, "_salt"], how).drop("_salt")
