"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from lexsieve.llm import (decontaminate, forest_join, grid_order_join, hard_negatives, html_cut, licenses, merkle, packing, quality,
                          substring_dedup, token_store, toxicity, vector_codes)
from lexsieve.plans.scale import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of `labels` on one scale: 0 junk, 1 fair but toxic, 2 good."""
    return table(spark, sf, "labels").where("quality is not null").select(
        "doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


#: A document stays when it is at least fair with a probability of one half.
KEEP_GRADE, KEEP_CUT = 1.0, 0.5


@query
def op1_ordinal_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Expected grade, P(at least fair) and the decision for every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train_ordinal(docs, graded(spark, sf))
    scored = quality.score_ordinal(docs, model, KEEP_GRADE)
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP_CUT).alias("keep"))


@query
def op2_template_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that holds a benchmark item, verbatim or re-parameterised, with the item."""
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), conflicts="cut")


@query
def op3_merkle_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the likenesses."""
    return merkle.edited_fingerprints(table(spark, sf, "documents"))


@query
def op4_cut_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf, "pages")
    return html_cut.extract_text(pages, html_cut.train_blocks(pages))


WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@query
def op5_token_store(spark: SparkSession, sf: str) -> DataFrame:
    """Position, length and checksum of the ids of every document, as read back from the store."""
    path = new_folder(spark, "token-store")
    token_store.write_store(table(spark, sf, "documents"), path, WORD_BPE, folds=True, end_id=2)
    return token_store.read_store(spark, path)


@query
def op6_bin_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.packed_sequences(table(spark, sf, "documents"), BYTE_BPE, end_id=0)


@query
def op7_forest_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Class and number of links of every document."""
    return forest_join.jaccard_classes(table(spark, sf, "documents"))


@query
def op8_nnpu_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document, learnt outside fold 0."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train_toxic(docs, table(spark, sf, "labels").where(~toxicity.held_out("doc_id")))
    return toxicity.score_toxic(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _license_sql() -> str:
    """The scan in SQL: words joined by spaces, places by comparing neighbours, templates as regular expressions."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    spots, base = [], []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        spots.append(f"list_filter(range(1, len(w) + 1), lambda i: {same})")
        base.append(f"CASE WHEN regexp_matches(s, ' {phrase} ') THEN ['{label}'] ELSE [] END")
    hit = lambda template: f"regexp_matches(s, ' {licenses.template_pattern(template)}')"
    anyof = lambda group: " OR ".join(map(hit, group))
    notices = [f"CASE WHEN {hit(t)} THEN ['{label}'] ELSE [] END" for label, (_, t) in licenses.NOTICES.items()]
    families = [f"CASE WHEN {hit(t)} THEN ['{family}'] ELSE [] END" for family, t in licenses.NOTICES.values()]
    said = [f"CASE WHEN {anyof(g)} THEN ['{label}'] ELSE [] END" for label, g in licenses.STATEMENTS.items()]
    opened = [f"CASE WHEN {anyof(g)} THEN ['{label}'] ELSE [] END" for label, g in licenses.OPENINGS.items()]
    flat = lambda lists: "flatten([" + ", ".join(lists) + "])"
    return f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
line AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM cut),
told AS (SELECT doc_id, len(w) AS n_words, {flat(spots)} AS p, {flat(base)} AS b, {flat(notices + said)} AS m, {flat(families)} AS f, {flat(opened)} AS o FROM line),
hits AS (SELECT *, list_filter(o, lambda x: NOT list_contains(f, x)) AS q FROM told)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(b)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(flatten([b, m, q]))), ','), '') AS labels,
  CASE WHEN len(m) > 0 THEN 1.0 WHEN len(o) > 0 THEN 0.75 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM hits"""


@query
def op9_template_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and accepted notices of every document."""
    return licenses.scan_licenses(table(spark, sf, "documents"))


ORACLE["op9_template_licenses"] = _license_sql()


@query
def op10_window_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that repeated 20-word windows remove, and the digest of what is left."""
    return substring_dedup.dedup_report(table(spark, sf, "documents"))


#: Usable vectors in SQL, as doubles.
_USABLE = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""


@query
def op11_grid_order_join(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.95."""
    return grid_order_join.cosine_classes(table(spark, sf, "embeddings"))


ORACLE["op11_grid_order_join"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_USABLE}),
ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.r),
root AS (SELECT a AS vec_id, min(r) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN root USING (vec_id) LEFT JOIN degree USING (vec_id)"""


@query
def op12_anchor_tree_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Code and error of every vector by the codebooks after four rounds."""
    return vector_codes.encode_vectors(table(spark, sf, "embeddings"))


def _codes_sql(rounds: int = 4) -> str:
    """Integer k-means written out: a codebook (part, entry, components) and an assignment for each round."""
    steps = ["book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, x AS e FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, p, x, hit.d AS d, hit.entry AS entry FROM (
  SELECT a.vec_id, a.p, any_value(a.x) AS x, min(struct_pack(d := list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.e) + list_inner_product(b.e, b.e), entry := b.entry)) AS hit
  FROM part a JOIN book{r} b USING (p) GROUP BY a.vec_id, a.p))""")
        if r < rounds:
            steps.append(f"""mean{r} AS (SELECT p, entry, list(m ORDER BY i) AS m FROM (
  SELECT p, entry, i, floor(sum(x[i]) / count(*)) AS m FROM near{r}, range(1, (SELECT max(len(x)) FROM part) + 1) t(i) GROUP BY p, entry, i) GROUP BY p, entry),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m, e) AS e FROM book{r} b LEFT JOIN mean{r} USING (p, entry))""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {_USABLE}),
part AS MATERIALIZED (SELECT vec_id, p, list_slice(v, (p * len(v) // 4 + 1)::BIGINT, ((p + 1) * len(v) // 4)::BIGINT) AS x FROM kept, range(4) t(p)),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: x::BIGINT), ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book{rounds}),
errors AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) JOIN errors ON errors.label IS NOT DISTINCT FROM kept.label, digest"""


ORACLE["op12_anchor_tree_codes"] = _codes_sql()


@query
def op13_spanning_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE["op13_spanning_negatives"] = f"""
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.l = c.l AS same, c.vec_id AS other, list_inner_product(a.v, c.v)::BIGINT AS s
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, s AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s AND s <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other) <= 5"""
