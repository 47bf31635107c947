"""Document fingerprints: Merkle trees over sections, paragraphs and lines, in Spark functions only.

A text is cut without loss: a leaf is a sentence or line with its end, a paragraph ends with a line feed, and a
section ends with a paragraph whose digest says so (one in eight), so that an insertion moves no later section
border. Every node is the SHA-256 of its children's digests; the root is equal for equal texts and differs for
others. The fingerprint is text: ``root|sections|paragraphs|leaves`` with digests cut to 12 hex digits, paragraphs
of a section joined by ',' and sections by ';', leaves as ``digest:characters``.

Likeness is the Jaccard index of the distinct leaves of two fingerprints, weighted by their characters; two
empty texts have likeness 1.

Edge cases: null texts are empty, with a root over no children; repeated rows are neighbours of each other, in
order of id, length and root; null ids come first; a single row is its own successor; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.plans.scale import partitions, spread

SHOWN = 12
#: Hex digits that end a section when a paragraph's digest ends with one of them.
SECTION_ENDS = ("0", "8")


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _present(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def _short(digests: Column, separator: str) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.substring(d, 1, SHOWN)), separator)


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """`df` with `<prefix>fingerprint` and `<prefix>leaves` (array of ``digest:characters``) of a text column.

    Each level is a column of its own, so no digest is computed twice.
    """
    piece, leaf, para, section = (f"_{prefix}{n}" for n in ("pieces", "leaf", "para", "section"))
    out = df.withColumn(piece, _present(F.split(text, r"(?<=\n)|(?<=[.!?] )")))
    out = out.withColumn(leaf, F.transform(piece, lambda p: F.concat(
        _digest(p), F.lit(":"), F.char_length(p).cast("string"), F.when(p.endswith("\n"), "\n").otherwise(" "))))
    # a paragraph is the run of leaves up to a line feed; its digest covers its leaves' entries
    out = out.withColumn(para, F.transform(_present(F.split(F.array_join(leaf, ""), "\n")), _digest))
    marked = F.array_join(F.transform(para, lambda d: F.concat(d, F.when(F.right(d, F.lit(1)).isin(*SECTION_ENDS), ";").otherwise(","))), "")
    out = out.withColumn(section, _present(F.split(marked, ";")))
    digests = F.transform(section, _digest)
    shown = F.array_join(F.transform(section, lambda s: _short(_present(F.split(s, ",")), ",")), ";")
    out = out.withColumn(f"{prefix}leaves", F.transform(leaf, lambda x: F.concat(
        F.substring(x, 1, SHOWN), F.substring(F.rtrim(F.translate(x, "\n", "")), 65, 12))))
    out = out.withColumn(f"{prefix}fingerprint", F.concat_ws(
        "|", _digest(F.array_join(digests, ",")), _short(digests, ","), shown, F.array_join(f"{prefix}leaves", ",")))
    return out.drop(piece, leaf, para, section)


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda a, x: a + F.substring(x, SHOWN + 2, 12).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Shared characters over all characters of the distinct leaves of two trees."""
    union = _weight(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(_weight(F.array_intersect(a, b)) / union)


def fingerprints(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, leaves) of each row."""
    rows = documents.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text"))
    return with_tree(spread(rows, "doc_id"), "_text", "").drop("_text")


def differing_paragraphs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """`pairs` with `<a>_edits` and `<b>_edits`: the paragraph numbers, from 0, of branches that the other fingerprint
    lacks. Equal roots give empty lists without a look at the branches."""
    def edits(own: str, other: str) -> Column:
        branches = lambda c: F.split(F.translate(F.split(c, r"\|")[2], ";", ","), ",")
        found = F.filter(F.transform(branches(own), lambda d, i: F.when(~F.array_contains(branches(other), d), i)), lambda i: i.isNotNull())
        same = F.substring(own, 1, 64) == F.substring(other, 1, 64)
        return F.when(same, F.array().cast("array<int>")).otherwise(found)

    return pairs.withColumns({f"{a}_edits": edits(a, b), f"{b}_edits": edits(b, a)})


def _bucket(column: str, bounds: list[int]) -> Column:
    """Number of bounds at or below the value; -1 for null."""
    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"if(`{column}` < {bounds[mid]}L, {tree(low, mid)}, {tree(mid + 1, high)})"

    return F.when(F.col(column).isNull(), -1).otherwise(F.expr(tree(0, len(bounds)))).cast("int")


def with_next(base: DataFrame, build: Callable[[DataFrame], DataFrame], key: str, order: list[str], carried: list[str]) -> DataFrame:
    """Each row of build(base) with `next_<c>` of its successor in the order (key first); the last row's is the first.

    Ranges of the key are cut at sketched quantiles, which steer only the balance. Inside a range the successor is the
    next row; a range's last row gets the first row of the next range that has rows. For that, the smallest key of
    each range comes from a scan of the keys, and only rows of these keys are built a second time.
    """
    n = partitions(base.sparkSession)
    at = base.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000).alias("b")).first()["b"] if n > 1 else None
    where = _bucket(key, sorted(set(at or [])))
    ranged = build(base).withColumn("_range", where).repartition(n, "_range")
    inside = Window.partitionBy("_range").orderBy(*order)
    lead = ranged.withColumns({f"next_{c}": F.lead(c).over(inside) for c in carried} | {"_last": F.lead(F.lit(False), 1, True).over(inside)})
    # the first row of each range; the broadcast has one row for each range
    least = base.groupBy(where.alias("_range")).agg(F.min(key).alias("_least"))
    heads = build(base.join(F.broadcast(least), base[key].eqNullSafe(F.col("_least")), "left_semi"))
    first = heads.groupBy(where.alias("_range")).agg(F.min(F.struct(*order, *carried)).alias("_first"))
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = first.select("_range").withColumn("_follow", F.coalesce(F.lead("_range").over(Window.orderBy("_range")), F.first("_range").over(every)))
    follow = ranges.join(first.select(F.col("_range").alias("_follow"), "_first"), "_follow").drop("_follow")
    joined = lead.join(follow, "_range", "left")
    return joined.withColumns({f"next_{c}": F.when(F.col("_last"), F.col(f"_first.{c}")).otherwise(F.col(f"next_{c}")) for c in carried}).drop(
        "_range", "_last", "_first")


def edited_fingerprints(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text is the text whose last half is replaced by as much of the beginning of the next text.
    """
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    near = with_next(
        spread(rows, "doc_id"), lambda part: with_tree(part, "text", "").withColumn("n_chars", F.char_length("text").cast("long")),
        "doc_id", ["doc_id", "n_chars", "fingerprint"], ["text", "leaves"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    near = near.withColumn("edited", F.concat(
        F.expr("substring(text, 1, int(n_chars) - int(floor(n_chars / 2)))"), F.substring("next_text", F.lit(1), half)))
    near = with_tree(near.withColumn("edited_sha256", _digest(F.col("edited"))).drop("text", "next_text"), "edited", "edited_")
    return near.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"))
