"""Benchmark decontamination by template canonicalisation.

Texts become token templates: numbers, names and units of measure turn into typed placeholders (slots), other
words are lower-cased. Windows of the templates of benchmark items and documents meet in a hash join. Matches of
one document and item on one diagonal (document position minus item position) form runs. Each value of the item
stands for one value of the document (two may stand for the same): on a diagonal the most frequent one; windows
that say otherwise are cut out, windows with the item's own values stay (conflicts="cut"), or the diagonal is
given up (conflicts="reject"). Runs of any diagonals that follow each other in the item and the document and agree on
their values form an alignment, so inserted or dropped words split nothing. An alignment that covers `coverage`
of the item's template is a leak, so a question with other numbers or names is caught as well.

* number: a word that begins with a digit, joined over single '.' or ',', or a spelled number, joined over ' ' or '-'
* unit: a word of UNITS behind a number
* name: capitalised words, not at the start of a sentence; neighbours form one name

A capitalised word that opens a sentence may be a name or not, so windows over one have two templates, with the
openers as words and as names. Windows with fewer than LEAST_WORDS plain words match by their verbatim values.

Edge cases: null texts are empty and match nothing; items shorter than a window that have fewer than LEAST_WORDS
plain words can't be told from chance and match nothing; other items shorter than a window form one window of their own length; repeated
rows give repeated evidence but one row for each (document, item); rows with a null id are left out; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.llm import rolling
from lexsieve.plans.scale import spread, written

WINDOW = 8
LEAST_WORDS = 4
#: Plain words that a window needs beside its sentence openers to be hashed with these as names.
LEAST_BESIDE_OPENERS = 2
COVERAGE = 0.5
#: Benchmark windows that travel to the document scan as a sorted array; more meet all windows in a shuffle join.
BROADCAST_WINDOWS = 4_000_000
#: Ids of leaking documents that travel to the documents; more are joined by a shuffle.
BROADCAST_DOCUMENTS = 500_000

# Fixed values.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
                "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million", "billion")
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "meter", "meters", "metre", "metres",
         "kilometer", "kilometers", "kilometre", "kilometres", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms",
         "ton", "tons", "lb", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "s", "ms", "min", "h",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
         "year", "years", "percent", "degree", "degrees", "dollar", "dollars", "euro", "euros", "cent", "cents",
         "mph", "kmh", "kb", "mb", "gb", "watt", "watts", "volt", "volts", "hz")

_NUMBER, _NAME, _UNIT = 1, 2, 3
_CODES = np.array([0, 0x51D3A1, 0x7C19E5, 0x2B0F77], np.uint64)


def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.unique(rolling.byte_hashes(data, np.concatenate(([0], ends[:-1])), ends))


_NUMBER_HASHES, _UNIT_HASHES = _hashes_of(NUMBER_WORDS), _hashes_of(UNITS)
_BREAK = np.isin(np.arange(256), list(b".!?:;\n\""))


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[rolling.Words, np.ndarray, np.ndarray]:
    """Template tokens of each document, the kind of each and the hash of the text that it stands for."""
    return _tokens(data, offsets)[:3]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[rolling.Words, np.ndarray, np.ndarray, np.ndarray]:
    """As `canonical`, with the plain tokens that may be names because they open a sentence with a capital."""
    words = rolling.cut_words(data, offsets, rolling.ALNUM)
    low, n = rolling.LOWER[data], len(words.starts)
    if not n:
        return words, np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, bool)
    plain = rolling.byte_hashes(low, words.starts, words.ends)
    first = data[words.starts]
    second = data[np.minimum(words.starts + 1, len(data) - 1)]
    long = words.ends - words.starts > 1
    follows = np.zeros(n, bool)
    follows[1:] = words.doc[1:] == words.doc[:-1]
    gap_from = np.concatenate(([0], words.ends[:-1]))
    breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
    inside = follows & (breaks[words.starts] == breaks[np.minimum(gap_from, words.starts)])
    gap = words.starts - gap_from

    kind = np.zeros(n, np.int8)
    spelled = np.isin(plain, _NUMBER_HASHES)
    kind[((first >= 48) & (first <= 57)) | spelled] = _NUMBER
    ascii_name = (first >= 65) & (first <= 90) & (((second >= 97) & (second <= 122)) | (second >= 128))
    latin_name = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    capital = (kind == 0) & long & (ascii_name | latin_name)
    kind[capital & inside] = _NAME
    before = np.concatenate(([0], kind[:-1]))
    kind[(kind == 0) & inside & (before == _NUMBER) & (gap <= 1) & np.isin(plain, _UNIT_HASHES)] = _UNIT

    sep = data[np.minimum(gap_from, len(data) - 1)]
    before = np.concatenate(([0], kind[:-1]))
    spelled[1:] &= spelled[:-1]
    spelled[:1] = False
    joined = follows & (gap == 1) & (((kind == _NUMBER) & (before == _NUMBER) & ((sep == 46) | (sep == 44)))
                                     | (spelled & ((sep == 32) | (sep == 45)))
                                     | ((kind == _NAME) & (before == _NAME) & (sep == 32)))
    head = np.flatnonzero(~joined)
    last = np.concatenate((head[1:], [n])) - 1
    value = rolling.byte_hashes(low, words.starts[head], words.ends[last])
    kind = kind[head]
    code = np.where(kind == 0, value, _CODES[kind])
    return rolling.Words(data, offsets, words.starts[head], words.ends[last], words.doc[head], code), kind, value, (capital & ~inside)[head]


@dataclass
class Windows:
    """Windows of one size: first token, hash, whether sentence openers count as names, whether told by values alone."""

    at: np.ndarray
    code: np.ndarray
    opened: np.ndarray
    verbatim: np.ndarray

    def where(self, good: np.ndarray) -> Windows:
        return Windows(self.at[good], self.code[good], self.opened[good], self.verbatim[good])


def _window_rows(words: rolling.Words, kind: np.ndarray, value: np.ndarray, openers: np.ndarray, size: int, verbatim: bool) -> Windows:
    """The windows: templates with enough plain words, and the values of the others where `verbatim` is set."""
    at, code = rolling.window_hashes(words, size)
    sums = [np.concatenate(([0], np.cumsum(mask))) for mask in (kind == 0, openers)]
    plain, opening = (s[at + size] - s[at] for s in sums)
    template = plain >= LEAST_WORDS
    opened = template & (opening > 0) & (plain - opening >= LEAST_BESIDE_OPENERS)
    # openers don't count here: the other text may hold them inside a sentence
    dense = (plain - opening < LEAST_WORDS) & verbatim
    found = [(at[template], code[template], False, False)]
    for good, codes, own in ((opened, np.where(openers, _CODES[_NAME], words.hashes), (True, False)), (dense, value, (False, True))):
        if good.any():
            found.append((at[good], rolling.range_windows(codes, at[good], size), *own))
    sizes = [len(f[0]) for f in found]
    return Windows(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]),
                   np.repeat([f[2] for f in found], sizes), np.repeat([f[3] for f in found], sizes))


def _batch(ids: np.ndarray, words: rolling.Words, kind: np.ndarray, value: np.ndarray, openers: np.ndarray, found: Windows,
           size: int) -> pa.RecordBatch:
    slot = kind > 0
    slots = [value[a:a + size][(slot[a:a + size] | (openers[a:a + size] & opened)) & ~verbatim].view(np.int64)
             for a, opened, verbatim in zip(found.at, found.opened, found.verbatim, strict=True)]
    first, row = words.first, words.doc[found.at]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[row]), pa.array(found.code.view(np.int64)), pa.array((found.at - first[row]).astype(np.int32)),
         pa.array(np.full(len(row), size, np.int32)), pa.array(np.diff(first)[row].astype(np.int32)),
         pa.array(slots, pa.list_(pa.int64())), pa.array(found.opened)], ["id", "hash", "pos", "size", "tokens", "slots", "opened"])


_SCHEMA = "id long, hash long, pos int, size int, tokens int, slots array<long>, opened boolean"


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """All template windows of (id, text); an item below the size is one window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text"):
                words, kind, value, openers = _tokens(data, offsets)
                ids, lengths = part.column(0).to_numpy(), np.diff(words.first)
                for own in [size, *np.unique(lengths[(lengths >= LEAST_WORDS) & (lengths < size)])]:
                    cuts = _window_rows(words, kind, value, openers, int(own), own == size)
                    if own < size:
                        cuts = cuts.where(lengths[words.doc[cuts.at]] == own)
                    yield _batch(ids, words, kind, value, openers, cuts, int(own))

    return items.mapInArrow(cut, _SCHEMA)


def document_windows(documents: DataFrame, sizes: list[int], known: np.ndarray | None, full: int = WINDOW) -> DataFrame:
    """Template windows of (id, text), of known hashes only if these are given; those of the full size also verbatim."""
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text"):
                words, kind, value, openers = _tokens(data, offsets)
                ids = part.column(0).to_numpy()
                for size in sizes:
                    cuts = _window_rows(words, kind, value, openers, size, size == full)
                    if wanted is not None:
                        near = np.minimum(np.searchsorted(wanted, cuts.code), max(len(wanted) - 1, 0))
                        cuts = cuts.where(wanted[near] == cuts.code if len(wanted) else np.zeros(len(cuts.code), bool))
                    if len(cuts.at):
                        yield _batch(ids, words, kind, value, openers, cuts, size)

    return documents.mapInArrow(cut, _SCHEMA)


def best_chain(item_from: np.ndarray, item_to: np.ndarray, doc_from: np.ndarray, same: np.ndarray,
               pairs: list[dict[int, int]]) -> tuple[int, bool, int, int]:
    """(covered item tokens, same values, doc_from, doc_to) of the best ordered chain of runs that agree on their values.

    Runs come sorted by item_from. A run that overlaps the one before it counts from there on; it takes the best chain
    before it that agrees with its values.
    """
    n, length = len(item_from), item_to - item_from
    doc_to = doc_from + length
    score, begin, chain_same, bound = length.copy(), doc_from.copy(), same.copy(), list(pairs)
    for q in range(1, n):
        lost = np.maximum(np.maximum(item_to[:q] - item_from[q], doc_to[:q] - doc_from[q]), 0)
        fits = np.flatnonzero((item_from[:q] < item_from[q]) & (doc_from[:q] < doc_from[q]) & (lost < np.minimum(length[q], score[:q])))
        gain = score[fits] - lost[fits]
        for p in fits[np.argsort(-gain, kind="stable")].tolist():
            if all(bound[p].get(k, v) == v for k, v in pairs[q].items()):
                score[q] = score[p] - lost[p] + length[q]
                begin[q], chain_same[q] = begin[p], chain_same[p] and same[q]
                bound[q] = bound[p] | pairs[q]
                break
    return max((int(score[q]), bool(chain_same[q]), -int(begin[q]), int(doc_to[q])) for q in range(n))


def _chains(table: pa.Table) -> pa.Table:
    """One row for the runs of one document and item."""
    table = table.sort_by([("item_from", "ascending"), ("doc_from", "ascending")])
    arrays = [table[c].to_numpy().astype(np.int64) for c in ("item_from", "item_to", "doc_from")]
    pairs = [{s["theirs"]: s["ours"] for s in row} for row in table["pairs"].to_pylist()]
    covered, same, back, doc_to = best_chain(*arrays, table["same"].to_numpy().astype(bool), pairs)
    return pa.table({"doc_id": table["doc_id"][:1], "item_id": table["item_id"][:1], "coverage": [covered / table["item_tokens"][0].as_py()],
                     "same_values": [same], "doc_from": pa.array([-back], pa.int32()), "doc_to": pa.array([doc_to], pa.int32())})


def leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text", size: int = WINDOW, coverage: float = COVERAGE, conflicts: str = "reject") -> DataFrame:
    """(doc_id, item_id, coverage, same_values, doc_from, doc_to) of each document that holds an item.

    coverage: share of the item's template tokens in the best consistent alignment; same_values: its slots hold
    the item's own values; doc_from and doc_to: the template tokens [from, to) of the document. conflicts: "cut" only
    the windows whose slots disagree with their diagonal, or "reject" the diagonal.
    """
    if conflicts not in ("cut", "reject"):
        raise ValueError(f"conflicts is 'cut' or 'reject', not {conflicts!r}")
    named = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text"))
    bench = written(item_windows(named, size), "items")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most `size` values
    n = bench.count()
    known = None
    if n <= BROADCAST_WINDOWS:
        known = np.unique(bench.select("hash").toArrow()["hash"].to_numpy().view(np.uint64))
    texts = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = document_windows(spread(texts, "id"), sizes, known, size)
    item = bench.select("hash", "size", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("tokens").alias("item_tokens"),
                        F.col("slots").alias("item_slots"), F.col("opened").alias("item_opened"))
    met = found.join(F.broadcast(item) if known is not None else item, ["hash", "size"]).select(
        F.col("id").alias("doc_id"), "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "pos", "item_pos", "size", "item_tokens",
        (F.col("opened") | F.col("item_opened")).alias("opened"),
        F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours")).alias("slots")).distinct()
    met = written(met, "matches")
    pair = ["doc_id", "item_id"]
    line = [*pair, "diagonal"]
    # all matches of a document and item together bound every alignment of them
    within = met.select(*pair, "item_tokens", F.explode(F.sequence("item_pos", F.col("item_pos") + F.col("size") - 1)).alias("token")).groupBy(*pair).agg(
        (F.countDistinct("token") / F.first("item_tokens")).alias("most")).where(F.col("most") >= coverage).select(*pair)
    # openers count as names only where the window does not match with them as words
    met = met.join(within, pair, "left_semi").withColumn("sure", F.min("opened").over(Window.partitionBy(*line, "item_pos")))
    met = met.where(F.col("opened") == F.col("sure")).drop("sure").withColumn("own", F.forall("slots", lambda s: s["theirs"] == s["ours"]))
    met = written(met, "candidates")
    votes = met.select(*line, "opened", F.explode(F.array_distinct("slots")).alias("s")).groupBy(*line, "s.theirs", "s.ours").agg(
        F.count("*").alias("n"), (F.min("opened") == F.lit(False)).cast("int").alias("sure"))
    chosen = votes.groupBy(*line, "theirs").agg(
        F.max(F.struct("n", (F.col("theirs") == F.col("ours")).alias("own"), "ours")).alias("b"), F.sum("sure").alias("values")).groupBy(*line).agg(
        F.map_from_entries(F.collect_list(F.struct("theirs", "b.ours"))).alias("chosen"), F.max("values").alias("values"))
    agrees = F.forall("slots", lambda s: F.element_at("chosen", s["theirs"]) == s["ours"])
    strict = F.lit(conflicts == "reject")
    kept = met.join(chosen, line, "left").where(
        (~strict | (F.coalesce("values", F.lit(0)) <= 1)) & (F.col("own") | agrees)).drop("chosen", "values")
    order = Window.partitionBy(*line).orderBy("item_pos")
    breaks = F.coalesce(F.col("item_pos") > F.max(F.col("item_pos") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    runs = kept.withColumn("breaks", breaks.cast("int")).withColumn("run", F.sum("breaks").over(order)).groupBy(*line, "run").agg(
        F.min("item_pos").alias("item_from"), F.max(F.col("item_pos") + F.col("size")).alias("item_to"), F.min("pos").alias("doc_from"),
        F.first("item_tokens").alias("item_tokens"), F.min("own").alias("same"),
        F.array_distinct(F.flatten(F.collect_set(F.when(strict | ~F.col("own"), F.col("slots"))))).alias("pairs"))
    best = runs.drop("diagonal", "run").groupBy(*pair).applyInArrow(
        _chains, "doc_id long, item_id long, coverage double, same_values boolean, doc_from int, doc_to int")
    return best.where(F.col("coverage") >= coverage)


def without_leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns; rows without an id stay."""
    leaked = written(leaks(documents, items, key=key, **options).select(F.col("doc_id").alias(key)).distinct(), "leaked")
    few = leaked.count() <= BROADCAST_DOCUMENTS
    return documents.join(F.broadcast(leaked) if few else leaked, key, "left_anti").select(*documents.columns)
