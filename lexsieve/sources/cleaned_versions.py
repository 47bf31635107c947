"""Cleaned text kept up with a changing corpus, as versions that each hold what changed.

Below ``path/mode=...`` stand ``data/v=N`` (rows cleaned for version N), ``gone/v=N`` (ids that version N retired)
and ``manifest/v=N`` (one row, written last). A version without its manifest is not seen by any reader, and the
next refresh writes over it: a lost run costs its work, never a mixed table. One writer at a time.

A row is known by its key and the digest of its text, so a row that only moves to another split is not cleaned again.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.functions import fixed
from lexsieve.functions.text import clean_raw, empty_if_null
from lexsieve.operators.cleaning import clean_aggressive
from lexsieve.plans.scale import written
from lexsieve.sources.corpus import content_digest

_MANIFEST = "version bigint, base bigint, settings string, stored bigint, live bigint, added bigint, retired bigint"
_DATA = "row_id string, text string, v bigint"
_GONE = "row_id string, v bigint"


@dataclass(frozen=True)
class Version:
    """A committed version: rows stored since ``base`` (the last full write), rows alive, rows added and retired by it."""

    version: int
    base: int
    settings: str
    stored: int
    live: int
    added: int
    retired: int


def row_id(key: str, text: str = "text") -> Column:
    """Identity of a row: its key (null keys are told from empty ones) and the digest of its text (null is empty)."""
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("~"))
    return F.sha2(F.concat_ws("\x1f", named, F.sha2(empty_if_null(text), 256)), 256)


def _folder(path: str, mode: str, part: str) -> str:
    return f"{path.rstrip('/')}/mode={mode}/{part}"


def versions(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """One row per committed version; empty before the first."""
    try:
        rows = spark.read.parquet(_folder(path, mode, "manifest"))
    except Exception as e:  # nothing committed yet: no folder, or one that holds no file
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], _MANIFEST)
    return rows.select(*[f.name for f in fields(Version)])


def _last(spark: SparkSession, path: str, mode: str, version: int | None = None) -> Version | None:
    rows = versions(spark, path, mode)
    row = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    return Version(*row) if row else None


def _live(spark: SparkSession, path: str, mode: str, at: Version) -> DataFrame:
    """(row_id, text, v) of a version. A row that was retired and came back counts from its last return."""
    span = F.col("v").between(at.base, at.version)
    data = spark.read.schema(_DATA).parquet(_folder(path, mode, "data")).where(span)
    if at.version == at.base:
        return data
    gone = spark.read.schema(_GONE).parquet(_folder(path, mode, "gone")).where(span)
    last_gone = gone.groupBy("row_id").agg(F.max("v").alias("_gone"))
    return data.join(last_gone, "row_id", "left").where("_gone is null or v > _gone").drop("_gone")


def _cleaned(rows: DataFrame, mode: str, dictionary: tuple[DataFrame, int] | None) -> DataFrame:
    """(row_id, text) of distinct rows."""
    if mode == "raw":
        return rows.select("row_id", clean_raw("text").alias("text"))
    return clean_aggressive(rows, *dictionary, "row_id")


def refresh_cleaned(split: DataFrame, path: str, mode: str, key: str = "link",
                    dictionary: tuple[DataFrame, int] | None = None, compact_at: float | None = 1.0) -> Version:
    """Bring the cleaned table up to the rows of ``split`` and return its version.

    Only rows with a new key or text are cleaned; ids that are no longer there are retired. Without any change
    the last version is returned and nothing is written. Another dictionary starts over. When the dead rows exceed
    ``compact_at`` times the live ones, the version is written in full as a new base; None never does. Rows with equal key
    and text are stored once; an empty ``split`` retires everything.
    """
    if mode not in fixed.CLEANING_MODES:
        raise ValueError(f"mode must be one of {fixed.CLEANING_MODES}, got {mode!r}")
    if mode == "aggressive" and dictionary is None:
        raise ValueError("aggressive cleaning needs a token dictionary")
    spark = split.sparkSession
    settings = mode if mode == "raw" else f"{mode} {content_digest(dictionary[0]).first()['digest']}"
    last = _last(spark, path, mode)
    number = last.version + 1 if last else 1
    known = last if last and last.settings == settings else None

    identified = split.select(row_id(key).alias("row_id"), "text")
    wanted = identified.select("row_id", F.lit(True).alias("wanted")).distinct()
    had = (_live(spark, path, mode, known).select("row_id", F.lit(True).alias("had")) if known
           else spark.createDataFrame([], "row_id string, had boolean"))
    change = written(wanted.join(had, "row_id", "full").where("wanted is null or had is null"), "cleaned-change")
    size = change.agg(F.count("wanted").alias("added"), F.count("had").alias("retired")).first()
    added, retired = size["added"], size["retired"]
    if known and not added and not retired:
        return known

    new_ids, gone_ids = (change.where(f"{c} is not null").select("row_id") for c in ("wanted", "had"))
    fresh = _cleaned(identified.join(new_ids, "row_id", "left_semi").dropDuplicates(["row_id"]), mode, dictionary)
    live = (known.live if known else 0) + added - retired
    stored = (known.stored if known else 0) + added
    base = known.base if known else number
    if known and compact_at is not None and stored - live > compact_at * live:
        kept = _live(spark, path, mode, known).select("row_id", "text").join(gone_ids, "row_id", "left_anti")
        fresh, base, stored = kept.union(fresh.select("row_id", "text")), number, live
    done = Version(number, base, settings, stored, live, added, retired)
    for part, rows in (("data", fresh.select("row_id", "text")), ("gone", gone_ids),
                       ("manifest", spark.createDataFrame([astuple(done)], _MANIFEST).coalesce(1))):
        rows.write.mode("overwrite").parquet(f"{_folder(path, mode, part)}/v={number}")
    return done


def cleaned_rows(split: DataFrame, path: str, mode: str, key: str = "link", version: int | None = None) -> DataFrame:
    """(split, key, text, added_in) for the rows of ``split`` that the version holds, the last one by default.

    ``added_in`` is the version whose files hold the text. Repeated rows come out as often as they stand in ``split``.
    """
    spark = split.sparkSession
    at = _last(spark, path, mode, version)
    if at is None:
        raise ValueError(f"no version {'' if version is None else version} of the cleaned text below {path}")
    live = _live(spark, path, mode, at).withColumnRenamed("v", "added_in")
    return split.select("split", key, row_id(key).alias("row_id")).join(live, "row_id").select("split", key, "text", "added_in")
