"""Cleaning, tokens, vocabulary, features and prompts over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import WITH_DOCS, docs_split, documents, r6, table
from lexsieve.functions import fixed
from lexsieve.functions import text as tx
from lexsieve.functions.responses import render_prompt
from lexsieve.operators import features as ft
from lexsieve.operators import vocabulary as vo
from lexsieve.operators.cleaning import clean_aggressive as aggressive
from lexsieve.operators.cleaning import token_dictionary
from lexsieve.plans.scale import new_folder, spread
from lexsieve.sources.cleaned_versions import cleaned_rows, refresh_cleaned
from lexsieve.sources.vectors import read_vectors, write_vectors

_MONEY = "(?i)" + fixed.MONEY_PATTERN
_PERCENT = fixed.PERCENT_PATTERN


def _mask_sql(column: str) -> str:
    return (f"regexp_replace(regexp_replace({column}, '{_MONEY}', '[VALOR_MONETARIO]', 'g'), "
            f"'{_PERCENT}', '[PERCENTUAL]', 'g')")


_SPACES = ("chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)"
           "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)"
           "||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)")
_NON_SPACE = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORDS = r"[\p{L}\p{N}_]{2,}"
_DOCS_TOKENS = f"tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORDS}') AS t FROM documents)"
_GRAMS = """gram AS (SELECT doc_id, unnest(t || list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok)"""


@query("mask_entities", f"""SELECT l_orderkey, l_linenumber, {_mask_sql('raw')} AS masked, count(*) AS n FROM (
  SELECT l_orderkey, l_linenumber, (CASE l_linenumber % 4 WHEN 0 THEN 'Vendeu R$ ' WHEN 1 THEN 'US$' WHEN 2 THEN 'custa $ ' ELSE 'total ' END)
    || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || (CASE l_linenumber % 3 WHEN 0 THEN ' mil' WHEN 1 THEN ',5 milhões' ELSE ' bilhete' END)
    || ', desconto de ' || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || CASE l_linenumber % 2 WHEN 0 THEN ' %' ELSE ',5%' END AS raw
  FROM lineitem) GROUP BY ALL""")
def mask_entities(spark, sf):
    line = F.col("l_linenumber")
    mark = F.when(line % 4 == 0, "Vendeu R$ ").when(line % 4 == 1, "US$").when(line % 4 == 2, "custa $ ").otherwise("total ")
    size = F.when(line % 3 == 0, " mil").when(line % 3 == 1, ",5 milhões").otherwise(" bilhete")
    share = F.when(line % 2 == 0, " %").otherwise(",5%")
    raw = F.concat(mark, F.floor("l_extendedprice").cast("string"), size, F.lit(", desconto de "),
                   F.round(F.col("l_discount") * 100).cast("bigint").cast("string"), share)
    lines = spread(table(spark, sf, "lineitem"), "l_orderkey")
    return lines.groupBy("l_orderkey", "l_linenumber", tx.mask_entities(raw).alias("masked")).agg(
        F.count(F.lit(1)).alias("n"))


@query("mask_documents", f"SELECT doc_id, {_mask_sql('text')} AS masked FROM documents")
def mask_documents(spark, sf):
    return documents(spark, sf).select("doc_id", tx.mask_entities("text").alias("masked"))


@query("clean_raw", f"SELECT doc_id, trim(nfc_normalize(coalesce(text, '')), {_SPACES}) AS text FROM documents")
def clean_raw(spark, sf):
    return documents(spark, sf).select("doc_id", tx.clean_raw("text").alias("text"))


@query("cleaned_versions", f"""SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 3 WHEN doc_id % 11 = 2 OR doc_id % 5 = 0 THEN 2 ELSE 1 END AS added_in,
  trim(nfc_normalize(coalesce(text, '') || CASE WHEN doc_id % 11 = 2 THEN ' emenda' ELSE '' END), {_SPACES}) AS text FROM documents""")
def cleaned_versions(spark, sf):
    """The whole table after it grew, was edited and lost rows, which then came back: three refreshes."""
    path, number = new_folder(spark, "cleaned"), F.col("doc_id")
    before = documents(spark, sf).select(F.lit("all").alias("split"), "doc_id", "text")
    after = before.withColumn("text", F.when(number % 11 == 2, F.concat(tx.empty_if_null("text"), F.lit(" emenda"))).otherwise(F.col("text")))
    for state in (before.where(number % 5 != 0), after.where(number % 7 != 1), after):
        refresh_cleaned(state, path, "raw", "doc_id", compact_at=None)
    return cleaned_rows(after, path, "raw", "doc_id").select("doc_id", F.col("added_in").cast("int").alias("added_in"), "text")


# stop words and lemmas are user tables; here both come from the words of the benchmark texts
_DICT_SQL = """bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark),
dict AS (SELECT w AS token, CASE WHEN length(w) > 4 AND w LIKE '%s' THEN substr(w, 1, length(w) - 1) END AS lemma, length(w) <= 2 AS is_stop FROM bw)"""


def _dictionary(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(tx.all_tokens("text"))).alias("word")).distinct()
    stops = words.where(F.length("word") <= 2)
    plural = words.where((F.length("word") > 4) & F.col("word").endswith("s"))
    lemmas = plural.select(F.col("word").alias("form"), F.expr("substring(word, 1, length(word) - 1)").alias("lemma"))
    return token_dictionary(stops, lemmas)


@query("clean_aggressive", f"""WITH {_DICT_SQL},
t AS (SELECT doc_id, regexp_extract_all(lower({_mask_sql("nfc_normalize(text)")}), '[\\p{{L}}\\p{{N}}_]+') AS l FROM documents),
p AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM t),
k AS (SELECT doc_id, string_agg(coalesce(lemma, p.token), ' ' ORDER BY pos) AS text FROM p LEFT JOIN dict ON p.token = dict.token
      WHERE NOT coalesce(is_stop, false) GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""")
def clean_aggressive(spark, sf):
    return aggressive(documents(spark, sf), *_dictionary(spark, sf), "doc_id")


@query("vocabulary", f"SELECT DISTINCT unnest(regexp_extract_all(text, '{_NON_SPACE}')) AS token FROM documents")
def vocabulary(spark, sf):
    return vo.token_vocabulary(documents(spark, sf))


@query("tokenize", f"WITH {_DOCS_TOKENS} SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM tok) GROUP BY token")
def tokenize(spark, sf):
    tokens = documents(spark, sf).select(F.explode(tx.word_tokens("text")).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("ngrams", f"WITH {_DOCS_TOKENS}, {_GRAMS} SELECT term, count(*) AS n FROM gram GROUP BY term")
def ngrams(spark, sf):
    return vo.counted_terms(documents(spark, sf), "text", fixed.TFIDF_NGRAMS)


_TRAIN_TOKENS = f"tok AS (SELECT doc_id, split, regexp_extract_all(lower(text), '{_WORDS}') AS t FROM split)"
_UNI = "gram AS (SELECT doc_id, unnest(t) AS term FROM tok)"


def _vocab_sql(grams: str) -> str:
    return f"""{_TRAIN_TOKENS}, {grams},
nd AS (SELECT count(*) AS nd FROM tok WHERE split = 'train'),
vocab AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (
  SELECT term, count(DISTINCT doc_id) AS df FROM gram JOIN tok USING (doc_id) WHERE split = 'train' GROUP BY term), nd
  WHERE df >= 5 AND df <= 0.95::DOUBLE * nd)"""


@query("vocab_fit", f"{WITH_DOCS}, {_vocab_sql(_GRAMS)} SELECT term, term_id, df FROM vocab")
def vocab_fit(spark, sf):
    train = docs_split(spark, sf).where(F.col("split") == "train")
    return vo.fit_vocabulary(train, ngram_range=fixed.TFIDF_NGRAMS).table


@query("bow", f"{WITH_DOCS}, {_vocab_sql(_UNI)} SELECT doc_id, split, term_id, count(*)::DOUBLE AS value FROM gram JOIN vocab USING (term) JOIN tok USING (doc_id) GROUP BY ALL")
def bow(spark, sf):
    split = docs_split(spark, sf)
    fitted = vo.fit_vocabulary(split.where(F.col("split") == "train"))
    return ft.bag_of_words(split, fitted, "doc_id", ("split",)).select("doc_id", "split", "term_id", "value")


@query("tfidf", f"""{WITH_DOCS}, {_vocab_sql(_GRAMS)},
w AS (SELECT doc_id, term_id, (1 + ln(count(*)::DOUBLE)) * (ln((1.0::DOUBLE + any_value(nd)) / (1.0::DOUBLE + any_value(df))) + 1) AS w
      FROM gram JOIN vocab USING (term), nd GROUP BY doc_id, term_id)
SELECT doc_id, term_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM w""")
def tfidf(spark, sf):
    split = docs_split(spark, sf)
    fitted = vo.fit_vocabulary(split.where(F.col("split") == "train"), ngram_range=fixed.TFIDF_NGRAMS)
    return ft.tfidf(split, fitted, "doc_id").select("doc_id", "term_id", r6(F.col("value"), "value"))


@query("embedding_source", """SELECT token, CAST(count(*) AS BIGINT) AS dims, round(sum(v::DOUBLE), 6) AS total FROM (
  SELECT 'w' || CAST(vec_id AS VARCHAR) AS token, unnest(embedding) AS v FROM embeddings) GROUP BY token""")
def embedding_source(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("token"), F.col("embedding").alias("vec"))
    path = new_folder(spark, "vectors")
    write_vectors(vectors, path)
    back = read_vectors(spark, path, vectors.select("token"), dim=64)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("token", F.size("vec").cast("bigint").alias("dims"), F.round(total, 6).alias("total"))


def term_vectors(spark, sf):
    """A vector for every term of the training texts: the ids of the table over and over."""
    split = docs_split(spark, sf)
    terms = vo.fit_vocabulary(split.where(F.col("split") == "train")).table
    vectors = table(spark, sf, "embeddings")
    return terms.join(vectors, F.col("term_id") % vectors.count() == F.col("vec_id")).select(
        F.col("term").alias("token"), F.col("embedding").alias("vec"))


@query("embedding_average", f"""{WITH_DOCS}, {_vocab_sql(_UNI)},
dict AS (SELECT term AS token, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM vocab JOIN embeddings ON vec_id = term_id % (SELECT count(*) FROM embeddings)),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_NON_SPACE}')) AS token FROM documents),
means AS (SELECT doc_id, dim, avg(v) AS value FROM words JOIN dict USING (token) GROUP BY doc_id, dim)
SELECT d.doc_id, CAST(d.dim AS INTEGER) AS dim, round(coalesce(value, 0), 6) + 0.0 AS value FROM (SELECT doc_id, unnest(range(64)) AS dim FROM documents) d
LEFT JOIN means ON means.doc_id = d.doc_id AND means.dim = d.dim""")
def embedding_average(spark, sf):
    split = docs_split(spark, sf)
    dictionary = term_vectors(spark, sf)
    docs = split.select("doc_id", F.lower("text").alias("text"))
    averaged = ft.embedding_average(docs, dictionary, dictionary.count(), 64, "doc_id")
    return averaged.select("doc_id", F.posexplode("vector").alias("dim", "v")).select(
        "doc_id", "dim", (F.round("v", 6) + 0.0).alias("value"))


_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, coalesce(u.text, '') AS title, coalesce(a.text, '') AS body FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')"""


def conversation_pairs(spark, sf):
    """Every turn with the assistant's direct reply, or none."""
    turns = table(spark, sf, "conversations")
    said = turns.select("conv_id", "turn", F.col("text").alias("title"))
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("body"))
    return said.join(reply, ["conv_id", "turn"], "left")


@query("render_prompt", f"""WITH {_PAIRS} SELECT conv_id, turn, 'T: ' || trim(nfc_normalize(title), {_SPACES}) || chr(10) || 'X: '
  || substr(trim(nfc_normalize(body), {_SPACES}), 1, 300) || ' {{fim}}' AS prompt FROM pairs""")
def prompts(spark, sf):
    template = "T: {title}\nX: {text} {{fim}}"
    return conversation_pairs(spark, sf).select(
        "conv_id", "turn", render_prompt(template, "title", "body", max_chars=300).alias("prompt"))
