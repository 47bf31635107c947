"""Labels, collapsed categories, class codes, slugs and run names as column expressions."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.functions import fixed
from lexsieve.functions.text import strip


def binary_label(category: Column | str, positive: str = fixed.POSITIVE_CATEGORY) -> Column:
    """1 for the positive category, 0 otherwise, null category included."""
    category = F.col(category) if isinstance(category, str) else category
    return F.coalesce(category == F.lit(positive), F.lit(False)).cast("tinyint")


def resolve_scheme(scheme: str | dict, positive: str = fixed.POSITIVE_CATEGORY) -> dict:
    """Look up a collapse scheme (by name or given as keep/sink) and check it."""
    if isinstance(scheme, str):
        if scheme not in fixed.COLLAPSE_SCHEMES:
            raise ValueError(f"unknown collapse scheme {scheme!r}, use one of {tuple(fixed.COLLAPSE_SCHEMES)}")
        scheme = fixed.COLLAPSE_SCHEMES[scheme]
    if positive not in scheme["keep"]:
        raise ValueError(f"collapse scheme does not keep the positive class {positive!r}")
    return {"keep": tuple(scheme["keep"]), "sink": scheme["sink"]}


def collapse_category(category: Column | str, keep: tuple[str, ...], sink: str) -> Column:
    category = F.col(category) if isinstance(category, str) else category
    return F.when(category.isin(*keep), category).otherwise(F.lit(sink))


def num_classes(scheme: dict) -> int:
    """Potential classes: the kept ones and the sink, observed or not."""
    return len(scheme["keep"]) + 1


def encode_classes(df: DataFrame, column: str, positive: str | None = None,
                   max_classes: int = 1000) -> dict[str, int]:
    """Alphabetical codes from 0 over the observed classes of ``column``.

    Classes are a label set, not data: the distinct values are counted against ``max_classes``
    before they become a driver-side mapping.
    """
    rows = df.select(column).distinct().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{column} has more than {max_classes} classes; it is not a label column")
    names = sorted(r[0] for r in rows if r[0] is not None)
    if positive is not None and positive not in names:
        raise ValueError(f"positive class {positive!r} is absent; found {names!r}")
    return {name: code for code, name in enumerate(names)}


def class_code(column: Column | str, encoding: dict[str, int]) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("int")
    for name, code in encoding.items():
        out = F.when(column == name, F.lit(code)).otherwise(out)
    return out


def target_tag(mode: Column | str, classes: Column | str) -> Column:
    """``bin`` or ``mc{K}`` from the target columns of a run."""
    mode = F.col(mode) if isinstance(mode, str) else mode
    classes = F.col(classes) if isinstance(classes, str) else classes
    return F.when(mode == "multiclass", F.concat(F.lit("mc"), classes.cast("string"))).otherwise("bin")


def variant_tag(mode: str, scheme: str | dict | None) -> str:
    if mode == "binary":
        return "bin"
    if mode == "multiclass":
        if scheme is None:
            raise ValueError("multiclass needs a collapse scheme")
        spec = fixed.COLLAPSE_SCHEMES[scheme] if isinstance(scheme, str) else scheme
        return f"mc{num_classes(spec)}"
    raise ValueError(f"target mode must be one of {fixed.TARGET_MODES}, got {mode!r}")


def variant_name(representation: str, cleaning: str, tag: str) -> str:
    short = {"aggressive": "aggr", "raw": "raw"}[cleaning]
    return f"{representation}-{short}-{tag}"


def slug(c: Column | str) -> Column:
    """Lower-case kebab form: runs of other characters become one dash, edges trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(F.regexp_replace(F.lower(strip(c)), fixed.SLUG_REJECTED, "-"), F.lit("-"))


def kebab(name: str) -> str:
    """``slug`` of a plain string."""
    return "-".join(re.findall(fixed.SLUG_KEPT, name.lower())).strip("-")


def run_name(generation: str, model: str, variant: str, when: dt.datetime) -> str:
    """Time stamp, generation, model and variant; only names that ``run_name_parts`` takes apart again exist."""
    stamp = when.strftime(fixed.RUN_STAMP_FORMAT)
    name = "__".join([stamp, generation, *map(kebab, (model, variant))])
    known = "|".join(map(re.escape, fixed.GENERATIONS))
    if not re.fullmatch(rf"{re.escape(stamp)}__(?:{known})(?:__{fixed.SLUG_KEPT}){{2}}", name):
        raise ValueError(f"no run name for generation {generation!r}, model {model!r}, variant {variant!r}; generations: {fixed.GENERATIONS}")
    return name


def run_name_parts(run_id: Column | str) -> dict[str, Column]:
    run_id = F.col(run_id) if isinstance(run_id, str) else run_id
    parts = F.split(run_id, "__", 4)
    names = ("stamp", "generation", "model", "variant")
    return {name: F.get(parts, F.lit(i)) for i, name in enumerate(names)}
