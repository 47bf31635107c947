"""Column expressions for cleaning, masking and tokenizing text.

Everything runs inside the JVM except Unicode normalization, which Spark lacks. That step is an
Arrow UDF which is handed only the strings it could change; all others reach it as null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexsieve.functions import fixed

# Code points outside the ranges that canonical composition never changes and never combines with
# a neighbour: all below U+0300, general punctuation without two aliased spaces, currency signs.
_NFC_UNSTABLE = r"[^\x00-\u02FF\u2002-\u205E\u20A0-\u20BF]"
_NON_ASCII = r"[^\x00-\x7F]"
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# The fixed patterns as Java regexes: Unicode classes, and the separators that \s leaves out there.
MONEY_PATTERN = "(?iuU)" + fixed.MONEY_PATTERN.replace(r"\s", r"[\s\x1c-\x1f]")
PERCENT_PATTERN = "(?U)" + fixed.PERCENT_PATTERN.replace(r"\s", r"[\s\x1c-\x1f]")
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _normalizer(form: str, ascii_only: bool):
    """Arrow UDF for one Unicode normal form (nested, so that it ships by value)."""
    @F.pandas_udf("string")
    def normalize(values: pd.Series) -> pd.Series:
        import unicodedata

        def one(s):
            if s is None:
                return None
            out = unicodedata.normalize(form, s)
            return out.encode("ascii", "ignore").decode("ascii") if ascii_only else out

        return values.map(one, na_action="ignore")

    return normalize


def nfc(c: Column | str) -> Column:
    """Canonical composition; only strings outside the stable range visit Python."""
    c = _col(c)
    return F.coalesce(_normalizer("NFC", False)(F.when(c.rlike(_NFC_UNSTABLE), c)), c)


def ascii_fold(c: Column | str) -> Column:
    """Compatibility decomposition with everything outside ASCII dropped."""
    c = _col(c)
    return F.coalesce(_normalizer("NFKD", True)(F.when(c.rlike(_NON_ASCII), c)), c)


def empty_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim Unicode whitespace on both ends (plain trim only knows the space)."""
    return F.btrim(_col(c), F.lit(fixed.WHITESPACE))


def mask_entities(c: Column | str) -> Column:
    """Replace money amounts, then percentages, by their placeholder."""
    money = F.regexp_replace(_col(c), MONEY_PATTERN, fixed.MONEY_TOKEN)
    return F.regexp_replace(money, PERCENT_PATTERN, fixed.PERCENT_TOKEN)


def clean_raw(c: Column | str, mask: bool = False) -> Column:
    """Null to empty, canonical composition, strip; masks only on request."""
    out = strip(nfc(empty_if_null(c)))
    return mask_entities(out) if mask else out


def whitespace_tokens(c: Column | str) -> Column:
    stripped = strip(c)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, _SPACE_RUN)
    )


def word_tokens(c: Column | str) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_PATTERN), F.lit(0))


def all_tokens(c: Column | str) -> Column:
    """Lower-cased runs of word characters, single ones included."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def _long_ngrams(tokens: Column, n: int) -> Column:
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.coalesce(joined, F.array().cast("array<string>"))


def ngrams(tokens: Column | str, low: int, high: int) -> Column:
    """All n-grams for low <= n <= high, each joined by one space."""
    if not 1 <= low <= high:
        raise ValueError(f"n-gram range must satisfy 1 <= low <= high, got ({low}, {high})")
    tokens = _col(tokens)
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(tokens)
        elif n == 2:
            length = F.greatest(F.size(tokens) - 1, F.lit(0))
            parts.append(F.zip_with(
                F.slice(tokens, F.lit(1), length),
                F.slice(tokens, F.lit(2), length),
                lambda a, b: F.concat(a, F.lit(" "), b),
            ))
        else:
            parts.append(_long_ngrams(tokens, n))
    return parts[0] if len(parts) == 1 else F.concat(*parts)
