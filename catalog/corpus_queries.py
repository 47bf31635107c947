"""Sources, derived columns, the split and the corpus profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import (DOCS_POSITIVE, ORDERS_POSITIVE, WITH_DOCS, WITH_ORDERS, docs_corpus, docs_split,
                           orders_corpus, orders_split, r6, table)
from lexsieve.functions import labels as lab
from lexsieve.operators import profile
from lexsieve.operators import split as sp
from lexsieve.plans.scale import new_folder
from lexsieve.sources import corpus as src

_DAY = "strftime(date, '%Y-%m-%d')"


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


@query("corpus_load", WITH_ORDERS + f"""SELECT link, title, text, {_DAY} AS date, category, CAST(label AS BIGINT) AS label FROM corpus""")
def corpus_load(spark, sf):
    path = new_folder(spark, "corpus")
    orders_corpus(spark, sf).drop("label").write.parquet(path)
    rows = src.load_corpus(spark, path, positive=ORDERS_POSITIVE)
    return rows.select("link", "title", "text", _day("date").alias("date"), "category",
                       F.col("label").cast("bigint").alias("label"))


@query("ingest_summary", WITH_DOCS + f"""SELECT count(*) AS n, min({_DAY}) AS date_min, max({_DAY}) AS date_max,
  count(*) FILTER (WHERE category = 'toxic') AS n_positive FROM corpus""")
def ingest_summary(spark, sf):
    raw = docs_corpus(spark, sf).select("title", "text", _day("date").alias("date"), "category", "link",
                                        F.lit(None).cast("string").alias("subcategory"))
    path = new_folder(spark, "ingest")
    raw.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{path}/csv")
    summary = src.convert_csv(spark, f"{path}/csv", f"{path}/parquet", DOCS_POSITIVE)
    return summary.select("n", _day("date_min").alias("date_min"), _day("date_max").alias("date_max"), "n_positive")


@query("content_digest", """SELECT lang, count(*) AS n_rows, CAST(sum(('0x' || substr(sha256(concat_ws(chr(31),
    coalesce('=' || CAST(doc_id AS VARCHAR), '~'), coalesce('=' || text, '~'), coalesce('=' || source, '~'),
    coalesce('=' || CAST(n_chars AS VARCHAR), '~'))), 1, 15))::BIGINT) AS VARCHAR) AS digest
  FROM documents GROUP BY lang""")
def content_digest(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars", "lang")
    return src.content_digest(rows, ["lang"])


@query("split_windows", WITH_ORDERS + f"""SELECT split, min({_DAY}) AS window_start, max({_DAY}) AS window_end, count(*) AS n
  FROM split GROUP BY split""")
def split_windows(spark, sf):
    path = new_folder(spark, "splits")
    src.write_splits(orders_split(spark, sf), path)
    return sp.split_windows(src.read_splits(spark, path))


@query("binary_label", """SELECT doc_id, CASE WHEN CASE WHEN toxic = 1 THEN 'toxic' END = 'toxic' THEN 1 ELSE 0 END AS label
  FROM documents LEFT JOIN labels USING (doc_id)""")
def binary_label(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    category = F.when(F.col("toxic") == 1, "toxic")  # null where unlabelled
    return docs.select("doc_id", lab.binary_label(category, "toxic").cast("int").alias("label"))


@query("collapse_categories", WITH_ORDERS + """SELECT CASE WHEN category IN ('BUILDING', 'MACHINERY') THEN category ELSE 'REST' END AS class,
  count(*) AS n, sum(label)::BIGINT AS n_positive FROM corpus GROUP BY 1""")
def collapse_categories(spark, sf):
    spec = lab.resolve_scheme({"keep": ("BUILDING", "MACHINERY"), "sink": "REST"}, ORDERS_POSITIVE)
    return orders_corpus(spark, sf).groupBy(
        lab.collapse_category("category", spec["keep"], spec["sink"]).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("n_positive"))


@query("label_encode", WITH_ORDERS + """, codes AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code
    FROM (SELECT DISTINCT category FROM split WHERE split = 'train'))
  SELECT link, category, CAST(code AS INTEGER) AS code, category = 'BUILDING' AS is_positive FROM split JOIN codes USING (category) WHERE split = 'train'""")
def label_encode(spark, sf):
    train = orders_split(spark, sf).where(F.col("split") == "train")
    encoding = lab.encode_classes(train, "category", ORDERS_POSITIVE)
    code = lab.class_code("category", encoding)
    return train.select("link", "category", code.alias("code"), (code == encoding[ORDERS_POSITIVE]).alias("is_positive"))


@query("slugify", """SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9.+-]+', '-', 'g'), '-') AS slug FROM pages""")
def slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", lab.slug("url").alias("slug"))


@query("oot_split", WITH_ORDERS + f"SELECT link, {_DAY} AS date, label, split FROM split")
def oot_split(spark, sf):
    return orders_split(spark, sf).select("link", _day("date").alias("date"), F.col("label").cast("int").alias("label"), "split")


@query("oot_split_subday", """WITH corpus AS (SELECT event_id, ts AS date FROM events WHERE ts IS NOT NULL),
n AS (SELECT count(*) AS n FROM corpus),
cum AS (SELECT date, sum(count(*)) OVER (ORDER BY date) AS c FROM corpus GROUP BY date),
bounds AS (SELECT min(date) FILTER (WHERE c > floor(n.n * 0.8::DOUBLE)) AS b1,
    min(date) FILTER (WHERE c > floor(n.n * (0.8::DOUBLE + 0.1::DOUBLE))) AS b2 FROM cum, n)
SELECT event_id, CASE WHEN date <= b1 THEN 'train' WHEN date <= b2 THEN 'val' ELSE 'test' END AS split FROM corpus, bounds""")
def oot_split_subday(spark, sf):
    rows = table(spark, sf, "events").where(F.col("ts").isNotNull()).select(
        "event_id", F.col("ts").alias("date"), (F.col("event_type") == "error").cast("int").alias("label"))
    return sp.split_out_of_time(rows, check=False).select("event_id", "split")


@query("split_index", WITH_ORDERS + """SELECT split, link, row_number() OVER (PARTITION BY split ORDER BY date, link) - 1 AS index FROM split""")
def split_index(spark, sf):
    return sp.split_row_index(orders_split(spark, sf).select("split", "date", "link")).select("split", "link", "index")


@query("split_head", WITH_ORDERS + """SELECT split, link, index FROM (
  SELECT split, link, row_number() OVER (PARTITION BY split ORDER BY date, link) - 1 AS index FROM split) WHERE index < 50""")
def split_head(spark, sf):
    from lexsieve.operators.scoring import first_rows

    return first_rows(sp.split_row_index(orders_split(spark, sf).select("split", "date", "link")), 50).select(
        "split", "link", "index")


@query("split_invariants", WITH_ORDERS + """, stats AS (SELECT split, count(*) AS n, min(date) AS lo, max(date) AS hi, sum(label)::BIGINT AS pos_count FROM split GROUP BY split)
  SELECT a.split, a.n, a.pos_count, a.n > 0 AS non_empty, a.pos_count > 0 AS has_positive, coalesce(a.lo > b.hi, true) AS after_prior
  FROM stats a LEFT JOIN stats b ON b.split = CASE a.split WHEN 'val' THEN 'train' WHEN 'test' THEN 'val' END""")
def split_invariants(spark, sf):
    return sp.split_invariants(orders_split(spark, sf))


@query("describe_split", WITH_ORDERS + f"""SELECT split, count(*) AS n, min({_DAY}) AS window_start, max({_DAY}) AS window_end,
  sum(label)::BIGINT AS pos_count, round(avg(label), 6) AS pos_ratio FROM split GROUP BY split""")
def describe_split(spark, sf):
    return sp.describe_split(orders_split(spark, sf)).withColumns(
        {"window_start": _day("window_start"), "window_end": _day("window_end")})


@query("split_summary", WITH_ORDERS + f"""SELECT coalesce(split, 'total') AS split, count(*) AS n,
  round(count(*)::DOUBLE / (SELECT count(*) FROM split), 6) AS share_total, sum(label)::BIGINT AS pos_count,
  round(avg(label), 6) AS pos_ratio,
  CASE WHEN split IS NOT NULL THEN min({_DAY}) END AS date_min, CASE WHEN split IS NOT NULL THEN max({_DAY}) END AS date_max,
  CASE WHEN split IS NOT NULL THEN date_diff('day', min(date), max(date)) + 1 END AS days_span,
  count(*) FILTER (WHERE text IS NULL) AS n_null_text FROM split GROUP BY ROLLUP (split)""")
def split_summary(spark, sf):
    return profile.split_summary(orders_split(spark, sf)).withColumns(
        {"share_total": r6(F.col("share_total")), "pos_ratio": r6(F.col("pos_ratio"))})


_CAT = WITH_ORDERS + """, tot AS (SELECT count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'val') AS va,
    count(*) FILTER (WHERE split = 'test') AS te FROM split),
  cat AS (SELECT category, count(*) FILTER (WHERE split = 'train') AS train_n, count(*) FILTER (WHERE split = 'val') AS val_n,
    count(*) FILTER (WHERE split = 'test') AS test_n, count(*) AS total_n FROM split GROUP BY category)
"""


@query("category_distribution", _CAT + """SELECT category, train_n, round(train_n::DOUBLE / tr, 6) AS train_share, val_n,
  round(val_n::DOUBLE / va, 6) AS val_share, test_n, round(test_n::DOUBLE / te, 6) AS test_share, total_n
  FROM cat, tot ORDER BY total_n DESC, category LIMIT 3""")
def category_distribution(spark, sf):
    return profile.category_distribution(orders_split(spark, sf), top_k=3).withColumns(
        {f"{s}_share": r6(F.col(f"{s}_share")) for s in ("train", "val", "test")})


@query("category_drift", _CAT + """SELECT category, total_n, round(train_n::DOUBLE / tr * 100, 6) AS train_share_pct,
  round(val_n::DOUBLE / va * 100, 6) AS val_share_pct, round(test_n::DOUBLE / te * 100, 6) AS test_share_pct,
  round((test_n::DOUBLE / te - train_n::DOUBLE / tr) * 100, 6) AS drift_test_minus_train_pp,
  round(abs((test_n::DOUBLE / te - train_n::DOUBLE / tr) * 100), 6) AS abs_drift FROM cat, tot WHERE total_n >= 500""")
def category_drift(spark, sf):
    out = profile.category_drift(orders_split(spark, sf), min_count=500)
    return out.withColumns({c: r6(F.col(c)) for c in out.columns[2:]})


@query("text_length_stats", WITH_DOCS + r""", l AS (SELECT split, length(coalesce(title, '')) AS ti, length(coalesce(text, '')) AS te,
    len(regexp_extract_all(coalesce(text, ''), '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+')) AS tk FROM split)
  SELECT split, round(avg(ti), 6) AS title_chars_mean, round(quantile_cont(ti, 0.5), 6) AS title_chars_median,
    round(avg(te), 6) AS text_chars_mean, round(quantile_cont(te, 0.5), 6) AS text_chars_median, round(quantile_cont(te, 0.95), 6) AS text_chars_p95,
    round(avg(tk), 6) AS text_tokens_mean, round(quantile_cont(tk, 0.5), 6) AS text_tokens_median, round(quantile_cont(tk, 0.95), 6) AS text_tokens_p95,
    round(quantile_cont(least(tk, 2000), 0.75), 6) AS clipped_tokens_q3
  FROM l GROUP BY split""")
def text_length_stats(spark, sf):
    out = profile.text_length_stats(docs_split(spark, sf))
    return out.withColumns({c: r6(F.col(c)) for c in out.columns[1:]})


_MONTHLY = """m AS (SELECT split, strftime(date, '%Y-%m') AS ym, count(*) AS n, sum(label)::BIGINT AS pos, round(avg(label), 6) AS pos_ratio
    FROM split GROUP BY 1, 2)"""


@query("monthly_volume", WITH_ORDERS + f", {_MONTHLY} SELECT * FROM m")
def monthly_volume(spark, sf):
    return profile.monthly_volume(orders_split(spark, sf)).withColumn("pos_ratio", r6(F.col("pos_ratio")))


@query("monthly_volume_dense", WITH_ORDERS + f""", {_MONTHLY}
  SELECT a.split, a.ym, n, pos, pos_ratio FROM (SELECT * FROM (SELECT DISTINCT ym FROM m), (SELECT unnest(['train', 'val', 'test']) AS split)) a
  LEFT JOIN m ON m.split = a.split AND m.ym = a.ym""")
def monthly_volume_dense(spark, sf):
    dense = profile.densify(profile.monthly_volume(orders_split(spark, sf)), "ym")
    return dense.withColumn("pos_ratio", r6(F.col("pos_ratio")))


_WEEKDAY = """w AS (SELECT split, CAST(isodow(date) - 1 AS BIGINT) AS weekday, count(*) AS n,
    round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM split GROUP BY 1, 2)"""


@query("weekday_distribution", WITH_ORDERS + f", {_WEEKDAY} SELECT * FROM w")
def weekday_distribution(spark, sf):
    return profile.weekday_distribution(orders_split(spark, sf)).withColumn("share", r6(F.col("share")))


@query("weekday_dense", WITH_DOCS + f""", {_WEEKDAY}
  SELECT a.split, a.weekday, n, share FROM (SELECT * FROM (SELECT DISTINCT weekday FROM w), (SELECT unnest(['train', 'val', 'test']) AS split)) a
  LEFT JOIN w ON w.split = a.split AND w.weekday = a.weekday""")
def weekday_dense(spark, sf):
    return profile.densify(profile.weekday_distribution(docs_split(spark, sf)), "weekday").withColumn(
        "share", r6(F.col("share")))


@query("positive_audit", WITH_ORDERS + """, c AS (SELECT split, category, sum(label)::BIGINT AS p FROM split GROUP BY 1, 2)
  SELECT split, sum(p)::BIGINT AS n_positive, arg_min(category, (-p, category)) FILTER (WHERE p > 0) AS positive_category_value,
    coalesce(max(p), 0) AS n_positive_cat, coalesce(bool_and(category = 'BUILDING') FILTER (WHERE p > 0), true) AS all_positive_in_class
  FROM c GROUP BY split""")
def positive_audit(spark, sf):
    return profile.positive_audit(orders_split(spark, sf), ORDERS_POSITIVE)
