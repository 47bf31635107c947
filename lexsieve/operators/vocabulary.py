"""Vocabulary fitted on training documents, and term counts against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.functions import fixed
from lexsieve.functions.text import ngrams, whitespace_tokens, word_tokens
from lexsieve.plans.scale import BROADCAST_BYTES, global_index, lookup, place_texts

TERM_ROW_BYTES = 64


@dataclass(frozen=True)
class Vocabulary:
    """Fitted terms: ``table`` holds (term, term_id, df); ids are the alphabetical rank."""

    table: DataFrame
    n_terms: int
    n_docs: int
    total_df: int
    ngram_range: tuple[int, int]


def with_terms(docs: DataFrame, text: str = "text", ngram_range: tuple[int, int] = fixed.BOW_NGRAMS,
               name: str = "terms") -> DataFrame:
    return docs.withColumn("_tokens", word_tokens(F.coalesce(text, F.lit("")))).withColumn(
        name, ngrams("_tokens", *ngram_range)).drop("_tokens")


def exploded(rows: DataFrame, array: str, name: str, *keep: str) -> DataFrame:
    """One row per array element.

    The outer form is deliberate: for the inner form the optimizer derives ``size(array) > 0`` and
    pushes it below the projection, which would tokenize every text a second time at the scan.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def counted_terms(docs: DataFrame, text: str = "text", ngram_range: tuple[int, int] = fixed.BOW_NGRAMS) -> DataFrame:
    """(term, n): all occurrences of each term.

    Words and pairs of neighbours are laid out from zipped arrays, in generated code; the arrays of joined pairs that
    ``with_terms`` makes are interpreted element by element and hold all of a document's pairs at once.
    """
    if ngram_range != (1, 2):
        terms = exploded(with_terms(docs, text, ngram_range), "terms", "term")
    else:
        tokens = docs.select(word_tokens(F.coalesce(text, F.lit(""))).alias("own"))
        after = F.slice("own", F.lit(2), F.size("own")).alias("next")
        pairs = exploded(tokens.select(F.arrays_zip("own", after).alias("zipped")), "zipped", "pair")
        word, neighbour = F.col("pair.own"), F.col("pair.next")
        terms = exploded(pairs.select(F.array(word, F.concat(word, F.lit(" "), neighbour)).alias("both")), "both", "term")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """Documents per term; each document contributes a term once, counters combine map-side."""
    once = docs.select(F.array_distinct(terms).alias("terms"))
    return exploded(once, "terms", "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fit_vocabulary(docs: DataFrame, text: str = "text", ngram_range: tuple[int, int] = fixed.BOW_NGRAMS,
                   min_df: int = fixed.MIN_DF, max_df: float = fixed.MAX_DF) -> Vocabulary:
    """Keep terms with min_df <= df <= max_df * n and number them alphabetically.

    Rare terms go before the numbering, which range-partitions the terms and writes them: the fitted
    table is fixed and later stages never recount it.
    """
    n_docs = docs.count()
    if n_docs == 0:
        raise ValueError("no documents to fit a vocabulary on")
    # a share is a float, a count of documents is an int
    ceiling = max_df * n_docs if isinstance(max_df, float) else max_df
    kept = document_frequency(with_terms(docs.select(text), text, ngram_range)).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.lit(ceiling)))
    table = global_index(kept, ["term"], "term_id").select("term", "term_id", "df")
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum("df").alias("t")).first()
    if not size["n"]:
        raise ValueError("no term is left after the document-frequency limits")
    return Vocabulary(table, size["n"], n_docs, size["t"], tuple(ngram_range))


def term_counts(docs: DataFrame, vocabulary: Vocabulary, doc_id: str, carry: tuple[str, ...] = (),
                text: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """(doc_id, *carry, term_id, df, n) for every known term of every document.

    Documents are placed by id before they are exploded: the text moves once and everything grouped
    by document afterwards (counts, norms, vectors) needs no further exchange. A vocabulary within the
    broadcast limit is joined before counting, so unknown terms never reach the aggregation and the
    counters are keyed by numbers; beyond the limit the terms are counted first to shuffle less.
    """
    placed = place_texts(docs.select(doc_id, *carry, text), doc_id, docs, text)
    terms = exploded(with_terms(placed, text, vocabulary.ngram_range), "terms", "term", doc_id, *carry)
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    size = dict(table_rows=vocabulary.n_terms, row_bytes=TERM_ROW_BYTES, how="inner", broadcast_bytes=limit)
    keys = [doc_id, *carry, "term_id", "df"]
    if vocabulary.n_terms * TERM_ROW_BYTES <= limit:
        return lookup(terms, vocabulary.table, "term", **size).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = terms.groupBy(doc_id, *carry, "term").agg(F.count(F.lit(1)).alias("n"))
    return lookup(counts, vocabulary.table, "term", salt_on=doc_id, weight="df",
                  weight_total=vocabulary.total_df, **size).select(*keys, "n")


def token_vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct whitespace tokens of all the documents."""
    tokens = docs.select(F.array_distinct(whitespace_tokens(F.coalesce(text, F.lit("")))).alias("tokens"))
    return exploded(tokens, "tokens", "token").distinct()
