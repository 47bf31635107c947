"""Replies of label classifiers: parsing, scores from log-probabilities, resume, counts; batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.text_queries import _PAIRS, _SPACES, conversation_pairs
from catalog.views import r6, table
from lexsieve.functions import fixed
from lexsieve.functions import responses as rs
from lexsieve.functions.text import whitespace_tokens
from lexsieve.operators import scoring as sc
from lexsieve.operators.classifiers import softmax_positive

_LABELS = ("the", "la", "en", "de")
_POSITIVE = "the"
_NON_SPACE = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _fold(c: str) -> str:
    return f"lower(regexp_replace(strip_accents({c}), '[^A-Za-z]', '', 'g'))"


_PARSED = f"""words AS (SELECT conv_id, turn, role, text, regexp_extract_all(text, '{_NON_SPACE}') AS w FROM conversations),
folded AS (SELECT *, {_fold("coalesce(w[1], '')")} AS first, {_fold("text")} AS whole FROM words),
parsed AS (SELECT *, CASE WHEN first = '' THEN NULL WHEN starts_with(first, 'the') THEN 'the' WHEN starts_with(first, 'la') THEN 'la'
    WHEN starts_with(first, 'en') THEN 'en' WHEN starts_with(first, 'de') THEN 'de' WHEN contains(whole, 'the') THEN 'the'
    WHEN contains(whole, 'la') THEN 'la' WHEN contains(whole, 'en') THEN 'en' WHEN contains(whole, 'de') THEN 'de' END AS label FROM folded)"""
# every word of an assistant turn as a candidate token, less likely the later it stands
_SCORED = f"""tokens AS (SELECT conv_id, turn, {_fold("unnest(w)")} AS tok, generate_subscripts(w, 1) * -0.25::DOUBLE AS lp FROM words WHERE role = 'assistant'),
owned AS (SELECT conv_id, turn, lp, CASE WHEN tok = '' THEN NULL WHEN starts_with(tok, 'the') OR starts_with('the', tok) THEN 'the'
    WHEN starts_with(tok, 'la') OR starts_with('la', tok) THEN 'la' WHEN starts_with(tok, 'en') OR starts_with('en', tok) THEN 'en'
    WHEN starts_with(tok, 'de') OR starts_with('de', tok) THEN 'de' END AS k FROM tokens),
best AS (SELECT conv_id, turn, k, max(lp) AS lp FROM owned WHERE k IS NOT NULL GROUP BY ALL),
scores AS (SELECT conv_id, turn, max(CASE WHEN k = 'the' THEN exp(lp) END) / sum(exp(lp)) AS score FROM (
    SELECT conv_id, turn, k, lp - max(lp) OVER (PARTITION BY conv_id, turn) AS lp FROM best) GROUP BY ALL)"""


def _replies(spark, sf):
    words = whitespace_tokens("text")
    candidates = F.transform(words, lambda t, i: F.struct(t.alias("token"), ((i + 1) * F.lit(-0.25)).alias("logprob")))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("raw_text"),
        F.when(F.col("role") == "assistant", candidates).alias("top_logprobs"))


@query("normalize_label", f"SELECT conv_id, turn, {_fold('text')} AS folded FROM conversations")
def normalize_label(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", rs.normalize_label("text").alias("folded"))


@query("parse_response", f"WITH {_PARSED} SELECT conv_id, turn, label, CASE WHEN label = 'the' THEN 1 ELSE 0 END AS y_pred FROM parsed")
def parse_response(spark, sf):
    label = rs.matched_label("raw_text", _LABELS, _POSITIVE)
    return _replies(spark, sf).withColumn("label", label).select(
        "conv_id", "turn", "label", rs.hard_prediction("label", _POSITIVE).alias("y_pred"))


@query("logprob_score", f"WITH {_PARSED}, {_SCORED} SELECT conv_id, turn, round(score, 6) AS score FROM words LEFT JOIN scores USING (conv_id, turn)")
def logprob_score(spark, sf):
    score = rs.logprob_score("top_logprobs", _POSITIVE, _LABELS[1:])
    return _replies(spark, sf).select("conv_id", "turn", r6(score, "score"))


@query("score_fallback", f"""WITH {_PARSED}, {_SCORED} SELECT conv_id, turn, label AS matched_label, CASE WHEN label = 'the' THEN 1 ELSE 0 END AS y_pred,
  round(coalesce(score, CASE WHEN label = 'the' THEN 1.0::DOUBLE ELSE 0 END), 6) AS y_score,
  CASE WHEN score IS NOT NULL THEN 'logprobs' WHEN label IS NOT NULL THEN 'hard' ELSE 'parse_failure' END AS score_source
  FROM parsed LEFT JOIN scores USING (conv_id, turn)""")
def score_fallback(spark, sf):
    return sc.score_replies(_replies(spark, sf), _LABELS, _POSITIVE).select(
        "conv_id", "turn", "matched_label", "y_pred", r6(F.col("y_score"), "y_score"), "score_source")


def word_client():
    """A stand-in for a served model: answers from words found in the prompt.

    The factory is nested, so it travels to the workers by value and needs no installed module.
    """
    def make():
        import math

        def ask(prompt: str):
            seconds = len(prompt) / 1e6
            if "tion" in prompt:
                return "mercado", [("mercado", math.log(0.9)), ("outros", math.log(0.1))], seconds
            if "the" in prompt:
                return "Outros.", None, seconds
            if "der" in prompt:
                return "?", None, seconds
            return "outros", [("Outros", math.log(0.8)), ("mer", math.log(0.2))], seconds

        return ask

    return make


_TEMPLATE = "T: {title} X: {text}"
_EXTERNAL = f"""{_PAIRS}, prompts AS (SELECT conv_id, turn, 'T: ' || trim(nfc_normalize(title), {_SPACES}) || ' X: ' || substr(trim(nfc_normalize(body), {_SPACES}), 1, 4000) AS prompt FROM pairs),
ext AS (SELECT conv_id, turn, length(prompt) / 1e6::DOUBLE AS latency_s, CASE WHEN contains(prompt, 'tion') THEN 'mercado' WHEN contains(prompt, 'the') THEN 'outros'
    WHEN contains(prompt, 'der') THEN NULL ELSE 'outros' END AS matched_label,
  CASE WHEN contains(prompt, 'tion') THEN 0.9::DOUBLE WHEN contains(prompt, 'the') THEN 0.0::DOUBLE WHEN contains(prompt, 'der') THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS y_score,
  CASE WHEN contains(prompt, 'tion') THEN 'logprobs' WHEN contains(prompt, 'the') THEN 'hard' WHEN contains(prompt, 'der') THEN 'parse_failure' ELSE 'logprobs' END AS score_source FROM prompts)"""


def _external(spark, sf):
    prompts = conversation_pairs(spark, sf).select(
        "conv_id", "turn", rs.render_prompt(_TEMPLATE, "title", "body").alias("prompt"))
    replies = sc.external_replies(prompts, "prompt", word_client())
    return sc.score_replies(replies, fixed.BINARY_LABELS, fixed.POSITIVE_CATEGORY)


@query("external_score", f"WITH {_EXTERNAL} SELECT conv_id, turn, round(latency_s, 6) AS latency_s, matched_label, CASE WHEN matched_label = 'mercado' THEN 1 ELSE 0 END AS y_pred, round(y_score, 6) AS y_score, score_source FROM ext")
def external_score(spark, sf):
    return _external(spark, sf).select("conv_id", "turn", r6(F.col("latency_s"), "latency_s"), "matched_label", "y_pred",
                                       r6(F.col("y_score"), "y_score"), "score_source")


@query("source_counts", f"""WITH {_EXTERNAL} SELECT turn, count(*) AS n_processed, count(*) FILTER (WHERE score_source = 'logprobs') AS n_logprobs,
  count(*) FILTER (WHERE score_source = 'hard') AS n_hard, count(*) FILTER (WHERE score_source = 'parse_failure') AS n_parse_failure FROM ext GROUP BY turn""")
def source_counts(spark, sf):
    return sc.source_counts(_external(spark, sf), ["turn"])


@query("label_counts", f"""WITH {_EXTERNAL} SELECT turn, count(*) FILTER (WHERE matched_label = 'mercado') AS label_mercado,
  count(*) FILTER (WHERE matched_label = 'outros') AS label_outros, count(*) FILTER (WHERE matched_label IS NULL) AS label_none FROM ext GROUP BY turn""")
def label_counts(spark, sf):
    return sc.label_counts(_external(spark, sf), fixed.BINARY_LABELS, ["turn"])


@query("resume_pending", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, sf):
    return sc.pending(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "lang", "n_chars")


@query("progress", """SELECT lang, count(*) AS n_total, count(l.doc_id) AS n_processed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def progress(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sc.progress(docs, docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"), "lang")


_LOGITS = """l AS (SELECT vec_id, [{}] AS logits FROM embeddings)""".format(", ".join(
    f"list_sum(list_transform(range(len(embedding)), lambda j: embedding[j + 1]::DOUBLE * ((j * {k + 2}) % 7 - 3) / 4))" for k in range(3)))


def linear_model():
    """A foreign batch model with fixed weights, three logits per vector."""
    def make():
        import numpy as np

        def predict(batch):
            j = np.arange(batch.shape[1])
            weights = np.stack([((j * (k + 2)) % 7 - 3) / 4.0 for k in range(3)], axis=1)
            return batch.astype(np.float64) @ weights

        return predict

    return make


@query("batch_score", f"WITH {_LOGITS} SELECT vec_id, round(exp(logits[2] - list_max(logits)) / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))), 6) AS y_score FROM l")
def batch_score(spark, sf):
    logits = sc.batch_logits("embedding", linear_model(), 64)
    scored = table(spark, sf, "embeddings").select("vec_id", logits.alias("logits"))
    return scored.select("vec_id", r6(softmax_positive("logits", 1), "y_score"))


@query("softmax_positive", "SELECT vec_id, round(exp(embedding[1]::DOUBLE - list_max(embedding)::DOUBLE) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS p FROM embeddings")
def softmax(spark, sf):
    logits = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", r6(softmax_positive(logits, 0), "p"))
