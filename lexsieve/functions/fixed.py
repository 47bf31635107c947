"""Everything here must stay exactly as written for results to match."""

from __future__ import annotations

# Target definition.
POSITIVE_CATEGORY = "mercado"
COLLAPSE_SCHEMES = {
    "top7_plus_other": {
        "keep": ("poder", "colunas", "mercado", "esporte", "mundo", "cotidiano", "ilustrada"),
        "sink": "outros",
    },
}
TARGET_MODES = ("binary", "multiclass")

# Response labels, in matching order.
BINARY_LABELS = ("mercado", "outros")
MULTICLASS_LABELS = (
    "mercado", "poder", "colunas", "esporte", "mundo", "cotidiano", "ilustrada", "outros",
)
SCORE_SOURCES = ("logprobs", "hard", "parse_failure")

# Corpus layout.
CORPUS_COLUMNS = ("title", "text", "date", "category", "link", "label")
CSV_REQUIRED_COLUMNS = ("title", "text", "date", "category", "link")
SPLITS = ("train", "val", "test")
CLEANING_MODES = ("raw", "aggressive")

# Masks.
MONEY_TOKEN = "[VALOR_MONETARIO]"
PERCENT_TOKEN = "[PERCENTUAL]"
# White space of a pattern is written \s; readers whose \s is narrower widen it (functions/text.py).
MONEY_PATTERN = r"(?:R\$|US\$|\$)\s*\d+(?:[.,]\d+)*(?:\s+(?:milh[õo]es|milh[ãa]o|bilh[õo]es|bilh[ãa]o|trilh[õo]es|trilh[ãa]o|mil|tri|bi|mi)\b)?"
PERCENT_PATTERN = r"\d+(?:[.,]\d+)*\s*%"

# Vectorizer defaults.
TFIDF_NGRAMS = (1, 2)
BOW_NGRAMS = (1, 1)
MIN_DF = 5
MAX_DF = 0.95
EMBEDDING_DIM = 300
MAX_PROMPT_CHARS = 4000

# Decision threshold grid, in hundredths: 0.05, 0.06, ..., 0.95.
GRID_FIRST = 5
GRID_LAST = 95
THRESHOLD_OBJECTIVES = ("f1_minority", "f1_macro")

# Paired test: below this many disagreements the exact binomial test is used.
MCNEMAR_EXACT_BELOW = 25
SIGNIFICANCE = 0.05

# Classifiers.
SEED = 1
CLASSIFIERS = ("linearsvc", "logreg", "multinomialnb", "complementnb", "lightgbm")
NON_NEGATIVE_CLASSIFIERS = ("multinomialnb", "complementnb")
REPRESENTATIONS = ("tfidf", "bow", "fasttext")

# Run registry.
GENERATIONS = ("gen1", "gen2", "gen3", "ensemble")
SLUG_REJECTED = "[^a-z0-9.+-]+"
SLUG_KEPT = "[a-z0-9.+-]+"
RUN_STAMP_FORMAT = "%Y%m%d-%H%M%S"
RUN_METADATA_KEYS = (
    "run_id", "git_commit", "started_at", "finished_at", "generation", "model", "variant",
    "config", "split", "threshold", "metrics", "efficiency",
)

# Characters removed by a Unicode whitespace strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Strings a CSV reader takes as missing.
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Columns that name a run, in the order in which reports are sorted.
REPORT_ORDER = ("representation", "model", "target_tag")
