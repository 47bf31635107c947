"""Views of the test tables that stand in for a dated, labelled corpus and its scored runs.

Each view exists twice: as a DataFrame and as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.functions.labels import binary_label
from lexsieve.operators.split import split_out_of_time
from lexsieve.operators.threshold import apply_thresholds, fit_thresholds
from lexsieve.plans.scale import spread

ORDERS_POSITIVE = "BUILDING"
DOCS_POSITIVE = "toxic"
DOCS_SCHEME = {"keep": ("en", "fr", "toxic"), "sink": "other"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The texts, spread by id when the file arrives as fewer tasks than there are cores."""
    return spread(table(spark, sf, "documents"), "doc_id")


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


# ---- orders as a corpus: one row per order, one category per market segment

ORDERS_CTE = """corpus AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS link, o_orderkey AS doc_id, o_custkey,
         CAST(o_orderdate AS TIMESTAMP) AS date, c_mktsegment AS category,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label,
         o_orderpriority AS title, nullif(o_orderstatus, 'P') AS text
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def orders_corpus(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("link"), F.col("o_orderkey").alias("doc_id"),
        "o_custkey", F.col("o_orderdate").alias("date"), F.col("c_mktsegment").alias("category"),
        binary_label("c_mktsegment", ORDERS_POSITIVE).alias("label"),
        F.col("o_orderpriority").alias("title"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("text"))


def orders_split(spark: SparkSession, sf: str) -> DataFrame:
    return split_out_of_time(orders_corpus(spark, sf))


# ---- documents as a corpus: ten documents a day in id order, category from the label or the language

_DOCS_BODY = """
  SELECT lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS link, d.doc_id,
         CAST(DATE '2020-01-01' + CAST(d.doc_id // 10 AS INTEGER) AS TIMESTAMP) AS date,
         CASE WHEN toxic = 1 THEN 'toxic' ELSE lang END AS category,
         CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS label, source AS title, text, lang
  FROM documents d {join} labels l ON d.doc_id = l.doc_id"""
DOCS_CTE = "corpus AS (" + _DOCS_BODY.format(join="LEFT JOIN") + ")"
LABELLED_CTE = "corpus AS (" + _DOCS_BODY.format(join="JOIN") + ")"


def docs_corpus(spark: SparkSession, sf: str, labelled: bool = False) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("doc_id") / 10).cast("int"))
    category = F.when(F.col("toxic") == 1, DOCS_POSITIVE).otherwise(F.col("lang"))
    return documents(spark, sf).join(labels, "doc_id", "inner" if labelled else "left").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("link"), "doc_id",
        day.cast("timestamp_ntz").alias("date"), category.alias("category"),
        binary_label(category, DOCS_POSITIVE).alias("label"), F.col("source").alias("title"), "text", "lang")


def docs_split(spark: SparkSession, sf: str, labelled: bool = False) -> DataFrame:
    return split_out_of_time(docs_corpus(spark, sf, labelled), check=False)


SPLIT_CTE = """n AS (SELECT count(*) AS n FROM corpus),
cum AS (SELECT date, sum(count(*)) OVER (ORDER BY date) AS c FROM corpus GROUP BY date),
bounds AS (
  SELECT min(date) FILTER (WHERE c > floor(n.n * 0.8::DOUBLE)) AS b1,
         min(date) FILTER (WHERE c > floor(n.n * (0.8::DOUBLE + 0.1::DOUBLE))) AS b2
  FROM cum, n),
split AS (
  SELECT corpus.*, CASE WHEN date <= b1 THEN 'train' WHEN date <= b2 THEN 'val' ELSE 'test' END AS split
  FROM corpus, bounds)"""

WITH_ORDERS = f"WITH {ORDERS_CTE},\n{SPLIT_CTE}\n"
WITH_DOCS = f"WITH {DOCS_CTE},\n{SPLIT_CTE}\n"
WITH_LABELLED = f"WITH {LABELLED_CTE},\n{SPLIT_CTE}\n"

# ---- scored runs over the orders corpus: score = noise * (1 - w) + w * label, with many ties

RUNS = (
    # stamp, generation, model, representation, tag, classes, multiplier, offset, weight of the label
    ("20260105-090000", "gen1", "logreg", "tfidf", "bin", 2, 7919, 104729, 0.20),
    ("20260105-100000", "gen1", "logreg", "tfidf", "mc8", 8, 6101, 15485863, 0.30),
    ("20260105-110000", "gen1", "multinomialnb", "bow", "bin", 2, 4211, 32452843, 0.25),
    ("20260105-120000", "gen1", "multinomialnb", "bow", "mc8", 8, 3571, 49979687, 0.22),
    ("20260106-090000", "gen2", "encoder", "raw", "bin", 2, 2741, 67867967, 0.40),
    ("20260106-100000", "gen2", "encoder", "raw", "mc8", 8, 1741, 86028121, 0.40),
)


def run_id(run: tuple) -> str:
    stamp, generation, model, representation, tag = run[:5]
    return f"{stamp}__{generation}__{model}__{variant(run)}"


def variant(run: tuple) -> str:
    return f"{run[3]}-aggr-{run[4]}" if run[1] == "gen1" else f"{run[3]}-ml256-{run[4]}"


RUN_IDS = tuple(run_id(r) for r in RUNS)


def _score_sql(run: tuple) -> str:
    m, o, w = run[6:9]
    noise = f"CAST((doc_id * {m} + o_custkey * {o}) % 997 AS DOUBLE) / CAST(997 AS DOUBLE)"
    return f"{noise} * CAST({round(1 - w, 2)} AS DOUBLE) + CAST({w} AS DOUBLE) * CAST(label AS DOUBLE)"


def _latency_sql(run: tuple) -> str:
    return f"CAST((doc_id * {run[6]}) % 89 + 1 AS DOUBLE) / CAST(1000000 AS DOUBLE)"


PREDICTIONS_CTE = "pred AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{run_id(r)}' AS run_id, split, doc_id AS index, label AS y_true, "
    f"{_score_sql(r)} AS y_score, {_latency_sql(r)} AS latency_s FROM split" for r in RUNS) + ")"
SWEEP_CTE = """grid AS (SELECT range / 100.0::DOUBLE AS threshold FROM range(5, 96)),
cells AS (
  SELECT run_id, threshold,
         CAST(count(*) FILTER (WHERE y_true = 1 AND y_score >= threshold) AS BIGINT) AS tp,
         CAST(count(*) FILTER (WHERE y_true = 0 AND y_score >= threshold) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE y_true = 1 AND y_score < threshold) AS BIGINT) AS fn,
         CAST(count(*) FILTER (WHERE y_true = 0 AND y_score < threshold) AS BIGINT) AS tn
  FROM pred, grid WHERE split = 'val' GROUP BY run_id, threshold),
sweep AS (
  SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_minority,
         coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1_negative
  FROM cells),
cuts AS (
  SELECT run_id, threshold, f1_minority FROM sweep
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY f1_minority DESC, threshold) = 1),
decided AS (
  SELECT pred.*, CASE WHEN y_score >= threshold THEN 1 ELSE 0 END AS y_pred, threshold
  FROM pred JOIN cuts USING (run_id))"""
# metrics of every run on its test rows
METRICS_CTE = """conf AS (
  SELECT run_id, any_value(threshold) AS threshold, count(*) AS n_test,
         count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
         count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn,
         sum(latency_s) * 1e6 / count(*) AS latency_ms_per_1k
  FROM decided WHERE split = 'test' GROUP BY run_id),
per_score AS (
  SELECT run_id, y_score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg
  FROM decided WHERE split = 'test' GROUP BY run_id, y_score),
ranked AS (
  SELECT *, sum(pos) OVER w AS tpc, sum(neg) OVER w AS fpc, sum(pos) OVER (PARTITION BY run_id) AS p,
         sum(neg) OVER (PARTITION BY run_id) AS n
  FROM per_score WINDOW w AS (PARTITION BY run_id ORDER BY y_score DESC)),
areas AS (
  SELECT run_id, sum(pos * tpc::DOUBLE / (tpc + fpc)) / any_value(p) AS pr_auc,
         sum(pos * (n - fpc + neg / 2.0::DOUBLE)) / any_value(p) / any_value(n) AS roc_auc
  FROM ranked GROUP BY run_id),
metrics AS (
  SELECT conf.*, pr_auc, roc_auc,
         coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision_minority,
         coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall_minority,
         coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_minority,
         coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1_negative,
         split_part(run_id, '__', 2) AS generation, split_part(run_id, '__', 3) AS model,
         split_part(run_id, '__', 4) AS variant
  FROM conf JOIN areas USING (run_id)),
summary AS (
  SELECT *, (f1_minority + f1_negative) / 2 AS f1_macro,
         split_part(variant, '-', 1) AS representation,
         CASE WHEN variant LIKE '%-mc8' THEN 'mc8' ELSE 'bin' END AS target_tag
  FROM metrics)"""

WITH_PRED = f"{WITH_ORDERS},\n{PREDICTIONS_CTE}\n"
WITH_DECIDED = f"{WITH_PRED},\n{SWEEP_CTE}\n"
WITH_SUMMARY = f"{WITH_DECIDED},\n{METRICS_CTE}\n"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every run's score of every order; runs are laid out inside the row, nothing is joined."""
    entries = F.array(*[F.struct(
        F.lit(run_id(r)).alias("run_id"), F.expr(_score_sql(r)).alias("y_score"),
        F.expr(_latency_sql(r)).alias("latency_s")) for r in RUNS])
    rows = orders_split(spark, sf).select("split", F.col("doc_id").alias("index"),
                                          F.col("label").cast("int").alias("y_true"), F.explode(entries).alias("e"))
    return rows.select("e.run_id", "split", "index", "y_true", "e.y_score", "e.latency_s")


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with the cut of their run, fitted on its validation rows."""
    pred = predictions(spark, sf)
    cuts = fit_thresholds(pred.where(F.col("split") == "val"), ["run_id"])
    return apply_thresholds(pred, cuts, ["run_id"])
