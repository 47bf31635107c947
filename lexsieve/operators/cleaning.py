"""Aggressive cleaning as a dictionary join, and the materialized cleaned text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.functions import fixed
from lexsieve.functions.text import all_tokens, clean_raw, empty_if_null, mask_entities, nfc
from lexsieve.plans.scale import BROADCAST_BYTES, durable, lookup, place_texts

#: A broadcast row of the dictionary.
ENTRY_BYTES = 80


def token_dictionary(stopwords: DataFrame, lemmas: DataFrame) -> tuple[DataFrame, int]:
    """Merge (word) and (form, lemma) into one fixed table (token, lemma, is_stop) and count it."""
    stops = stopwords.select(F.lower("word").alias("token"), F.lit(True).alias("is_stop")).distinct()
    forms = lemmas.groupBy(F.lower("form").alias("token")).agg(F.min(F.lower("lemma")).alias("lemma"))
    table = durable(forms.join(stops, "token", "full").select(
        "token", "lemma", F.coalesce("is_stop", F.lit(False)).alias("is_stop")))
    return table, table.count()


def _used_entries(tokens: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, int]:
    """The entries of all tokens in use with their number of uses, and the number of tokens.

    Tokens without an entry are kept too: one that is frequent must be salted like any other.
    """
    uses = tokens.where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    used = durable(uses.join(dictionary, "token", "left"))
    return used, used.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]


def clean_aggressive(docs: DataFrame, dictionary: DataFrame, dictionary_rows: int, doc_id: str,
                     text: str = "text", mask: bool = True, broadcast_bytes: int | None = None) -> DataFrame:
    """(doc_id, text): lower-cased lemmas without stop words and punctuation, joined by a space.

    The token pattern keeps the underscore and drops brackets, so a mask survives as one token.
    Documents are placed by id before they are exploded: with a broadcast dictionary the regrouping
    is local. Normalization comes before the placement, because Python evaluation forgets it.
    """
    prepared = nfc(empty_if_null(text))
    prepared = mask_entities(prepared) if mask else prepared
    placed = place_texts(docs.select(doc_id, prepared.alias("_text")), doc_id, docs, text)
    tokens = placed.select(doc_id, F.posexplode_outer(all_tokens("_text")).alias("pos", "token"))
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if dictionary_rows * ENTRY_BYTES <= limit:
        joined = lookup(tokens, dictionary, "token", table_rows=dictionary_rows, row_bytes=ENTRY_BYTES, broadcast_bytes=limit)
    else:
        used, n_tokens = _used_entries(tokens, dictionary)
        joined = lookup(tokens, used, "token", table_rows=dictionary_rows, row_bytes=ENTRY_BYTES, salt_on="pos",
                        weight="uses", weight_total=n_tokens, broadcast_bytes=limit)
    lemma = F.coalesce("lemma", "token")
    kept = F.when(F.col("token").isNotNull() & ~F.coalesce("is_stop", F.lit(False)) & (F.trim(lemma) != ""),
                  F.struct("pos", lemma.alias("lemma")))
    words = F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["lemma"])
    return joined.groupBy(doc_id).agg(F.array_join(words, " ").alias("text"))


def cleaned_table(split: DataFrame, path: str, mode: str, key: str = "link", force: bool = False,
                  dictionary: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Cleaned text kept in a table (split, mode, key, text); reused until the keys or the texts change.

    Each row keeps a digest of the text it was made from; keys and digests decide. A stale table raises
    unless ``force``.
    """
    if mode not in fixed.CLEANING_MODES:
        raise ValueError(f"mode must be one of {fixed.CLEANING_MODES}, got {mode!r}")
    if mode == "aggressive" and dictionary is None:
        raise ValueError("aggressive cleaning needs a token dictionary")
    spark = split.sparkSession
    sources = split.select("split", key, F.sha2(empty_if_null("text"), 256).alias("source_digest"))
    target = f"{path.rstrip('/')}/mode={mode}"
    if not force:
        try:
            stored = spark.read.parquet(target)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
        if stored is not None:
            left, right = sources, stored.select("split", key, "source_digest")
            if not left.exceptAll(right).isEmpty() or not right.exceptAll(left).isEmpty():
                raise ValueError(f"{target} was built for other rows; pass force=True")
            return stored.drop("source_digest")
    if mode == "raw":
        cleaned = split.select("split", key, clean_raw("text").alias("text"))
    else:
        cleaned = split.select("split", key).join(clean_aggressive(split, *dictionary, key), key)
    cleaned.join(sources, ["split", key]).write.mode("overwrite").partitionBy("split").parquet(target)
    return spark.read.parquet(target).drop("source_digest")
