"""Substring dedup: Rabin-Karp hashes of fixed-length token windows, counted in Spark.

A window of `size` consecutive words is redundant when its word sequence also starts earlier: in a row with
a smaller id, or earlier in the same document. Redundant windows of a document merge into maximal removal
intervals.

How windows meet without shuffling every one of them: each window contains ``size - GRAM + 1`` short grams;
its *anchor* is the gram with the smallest hash, the leftmost on ties. Equal windows have equal anchors at the
same place, so an anchor that occurs at one place of the corpus proves all its windows unique. Anchors are
counted over all documents; every window of a repeated anchor is hashed, grouped over the corpus and resolved
to its first start. Nothing is sampled or capped. Documents with equal word sequences are resolved as wholes:
the later ones lose every window, so only the first is cut into windows.

Words are runs of bytes other than ASCII white space, unchanged.

Edge cases: null text counts as empty; shorter documents have no window and lose nothing; rows that repeat an
id and its text are one document and get the same result; of different texts under one id only the one with
the smallest hash takes part and the others lose nothing, unless they are later copies as wholes; rows with
a null id take no part and lose nothing; extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.llm import rolling
from lexsieve.plans.scale import spread, written

WINDOW = 20
GRAM = 6
#: Counted bytes of per-document findings that are broadcast to the next text scan; beyond, the texts are shuffled.
BROADCAST_BYTES = 96 << 20
_PLACE = np.uint64((1 << 24) - 1)


def _anchors(words: rolling.Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window and the gram index of its anchor, with the gram hashes behind that index."""
    n = len(words.hashes)
    at = np.flatnonzero(words.doc[:max(n - size + 1, 0)] == words.doc[size - 1:]) if n >= size else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    starts = np.arange(n - gram + 1)
    grams = rolling.range_hashes(words.hashes, starts, starts + gram, 0xA0761D6478BD642F)
    width = size - gram + 1
    lowest, span = (grams & ~_PLACE) | starts.astype(np.uint64), 1
    while 2 * span <= width:  # minima over doubling spans, then one overlapping pair
        lowest = np.minimum(lowest[:-span], lowest[span:])
        span *= 2
    rest = width - span
    if rest:
        lowest = np.minimum(lowest[:-rest], lowest[rest:])
    place = (lowest[at] & _PLACE).astype(np.int64)
    return at, np.stack((place.astype(np.uint64), grams[place]))


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Values grouped by their ascending row."""
    bounds = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))


def _node(words: rolling.Words) -> np.ndarray:
    """64-bit id of the word sequence of each document."""
    first = words.first
    return (rolling.sequence_hashes(words.hashes, first) ^ rolling.mix(np.diff(first).astype(np.uint64))).view(np.int64)


def surveyed(documents: DataFrame, size: int, gram: int) -> DataFrame:
    """(doc_id, node, n_words, whole_sha256, anchors, again): the anchors of each document, and those it has twice."""
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text"):
                words = rolling.cut_words(data, offsets, rolling.GRAPHIC)
                n, first = part.num_rows, words.first
                at, found = _anchors(words, size, gram)
                if len(at):
                    doc, place, code = words.doc[at], found[0], found[1]
                    fresh = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
                    doc, code = doc[fresh], code[fresh]
                    order = np.lexsort((code, doc))
                    doc, code = doc[order], code[order]
                    new = np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
                    second = ~new & np.concatenate(([False], new[:-1]))
                    lists = [_lists(doc[k], code[k].view(np.int64), n) for k in (new, second)]
                else:
                    lists = [_lists(np.zeros(0, np.int64), np.zeros(0, np.int64), n)] * 2
                sums = [hashlib.sha256(b" ".join(data[a:b].tobytes().split())).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_node(words)), pa.array(np.diff(first)), pa.array(sums, pa.binary()), *lists],
                    ["doc_id", "node", "n_words", "whole_sha256", "anchors", "again"])

    return documents.mapInArrow(
        survey, "doc_id long, node long, n_words long, whole_sha256 binary, anchors array<long>, again array<long>")


def windows_of(candidates: DataFrame, size: int, gram: int) -> DataFrame:
    """Windows with a repeated anchor, told once by each slice of rows.

    A row (hash, doc_id, pos) for the earliest start of a window in the slice; other starts are redundant
    already and come as one row (doc_id, late) for each document. So a window that fills the corpus sends a row
    for each slice at most.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text"):
                words = rolling.cut_words(data, offsets, rolling.GRAPHIC)
                ids, first = part.column(0).to_numpy(), words.first
                at, found = _anchors(words, size, gram)
                if not len(at):
                    continue
                mine = _node(words) == part.column(3).to_numpy()
                wanted = np.unique(part.column(2).flatten().to_numpy())
                top = (found[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                at = at[mine[words.doc[at]] & np.isin(top, wanted)]
                if not len(at):
                    continue
                code = rolling.range_hashes(words.hashes, at, at + size, 0xD6E8FEB86659FD93)
                owner = ids[words.doc[at]]
                order = np.lexsort((at, owner, code))
                fresh = np.concatenate(([True], code[order][1:] != code[order][:-1]))
                lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]
                pos = at - first[words.doc[at]]
                late, head = np.zeros(len(at), bool), np.zeros(len(at), bool)
                head[order[fresh]] = True
                late[order] = (owner[order] != owner[lead]) | (pos[order] != pos[lead])
                rows, places = words.doc[at][late], pos[late].astype(np.int32)
                docs = np.unique(rows)
                n = int(head.sum())
                yield pa.RecordBatch.from_arrays(
                    # late rows wait for no one: a key for each document deals them out evenly
                    [pa.concat_arrays([pa.array(code[head].view(np.int64)), pa.array(rolling.mix(ids[docs].astype(np.uint64)).view(np.int64))]),
                     pa.concat_arrays([pa.array(owner[head]), pa.array(ids[docs])]),
                     pa.concat_arrays([pa.array(pos[head].astype(np.int32)), pa.nulls(len(docs), pa.int32())]),
                     pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), _lists(np.searchsorted(docs, rows), places, len(docs))])],
                    ["hash", "doc_id", "pos", "late"])

    return candidates.mapInArrow(cut, "hash long, doc_id long, pos int, late array<int>")


def _meet(texts: DataFrame, found: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Join findings of documents to their texts; small findings travel to the scan, large ones meet in a shuffle."""
    held = found.agg(F.sum(8 * F.size(column) + 48)).first()[0] or 0
    return texts.join(F.broadcast(found) if held <= BROADCAST_BYTES else found, "doc_id", how)


def removal_spans(documents: DataFrame, size: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The survey rows of all documents with a flag for later copies, and (doc_id, spans, node) of removal intervals.

    documents: doc_id, text with non-null ids. Later copies are flagged and have no spans.
    """
    survey = written(surveyed(documents, size, gram), "survey")
    firsts = survey.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    rows = survey.drop("anchors", "again").join(firsts, "node").withColumn("copy", F.col("doc_id") > F.col("first_id")).drop("first_id")
    rows = written(rows, "rows")
    own = rows.where(~F.col("copy")).groupBy("doc_id").agg(F.min("node").alias("node"))

    repeated = survey.select(F.explode(F.concat("anchors", "again")).alias("anchor")).groupBy("anchor").agg(
        F.count("*").alias("n")).where("n > 1").select("anchor")
    spots = survey.select("doc_id", F.explode("anchors").alias("anchor"))
    held = spots.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_set(F.shiftright("anchor", 32).cast("int")).alias("wanted"))
    held = written(held.join(own, "doc_id"), "anchors")
    met = _meet(documents, held, "wanted").select("doc_id", "text", "wanted", "node")
    # starts within a document are settled, so only the smallest id of a window is wanted
    everywhere = Window.partitionBy("hash")
    settled = windows_of(met, size, gram).withColumn("first_id", F.min(F.when(F.col("pos").isNotNull(), F.col("doc_id"))).over(everywhere))
    late = settled.where("pos is null or doc_id > first_id").select("doc_id", F.coalesce("late", F.array("pos")).alias("late"))
    merged = late.groupBy("doc_id").agg(F.flatten(F.collect_list("late")).alias("starts"))
    return rows, written(intervals(merged, size).join(own, "doc_id"), "spans")


def intervals(starts: DataFrame, size: int) -> DataFrame:
    """(doc_id, spans): the maximal removal intervals that the windows at `starts` cover, as flat [from, to) pairs of words."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for k in range(batch.num_rows):
                pos = np.unique(batch.column(1)[k].values.to_numpy())
                gap = np.flatnonzero(np.diff(pos) > size)
                spans.append(np.stack((pos[np.concatenate(([0], gap + 1))], pos[np.append(gap, len(pos) - 1)] + size), axis=1).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int32()))], ["doc_id", "spans"])

    return starts.mapInArrow(merge, "doc_id long, spans array<int>")


def _without(words: rolling.Words, i: int, spans: np.ndarray) -> bytes:
    """Text of document i without the words of the spans and the white space behind them."""
    a, b = np.searchsorted(words.doc, (i, i + 1))
    pieces, at, end = [], int(words.offsets[i]), int(words.offsets[i + 1])
    for x, y in spans:
        pieces.append(words.data[at:words.starts[a + x]].tobytes())
        at = int(words.starts[a + y]) if a + y < b else end
    return b"".join([*pieces, words.data[at:end].tobytes()])


def cut_texts(found: DataFrame) -> DataFrame:
    """(doc_id, node, n_removed, kept_sha256, kept_text) of documents with removal intervals.

    found: doc_id, text, spans, node. kept_text is the text without the intervals, everything else unchanged.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, "text"):
                words = rolling.cut_words(data, offsets, rolling.GRAPHIC)
                node = _node(words)
                mine = np.flatnonzero(node == part.column(3).to_numpy())
                removed, sums, kept = [], [], []
                for i in mine:
                    spans = part.column(2)[int(i)].values.to_numpy().reshape(-1, 2)
                    left = _without(words, int(i), spans)
                    removed.append(int(np.diff(spans).sum()))
                    sums.append(hashlib.sha256(b" ".join(left.split())).digest())
                    kept.append(left.decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(mine)), pa.array(node[mine]), pa.array(removed, pa.int64()),
                     pa.array(sums, pa.binary()), pa.array(kept, pa.string())],
                    ["doc_id", "node", "n_removed", "kept_sha256", "kept_text"])

    return found.select("doc_id", "text", "spans", "node").mapInArrow(
        cut, "doc_id long, node long, n_removed long, kept_sha256 binary, kept_text string")


def dedup_report(documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; the digest is of the kept words joined by one space."""
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = spread(texts.where("doc_id is not null"), "doc_id")
    rows, spans = removal_spans(known, size)
    changed = cut_texts(_meet(known, spans, "spans")).select("doc_id", "node", "n_removed", "kept_sha256").distinct()
    nothing = hashlib.sha256(b"").digest()
    shown = lambda digest: F.lower(F.hex(digest)).alias("kept_sha256")
    gone = F.col("copy") & (F.col("n_words") >= size)
    out = rows.join(changed, ["doc_id", "node"], "left").select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        shown(F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "whole_sha256"))))
    nameless = surveyed(texts.where("doc_id is null"), size, GRAM).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), shown("whole_sha256"))
    return out.unionByName(nameless)


def without_repeats(documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """`documents` with the removal intervals cut out of `text`; a later copy of a whole text becomes empty.

    White space inside the kept parts stays as it is. Rows are neither added nor dropped.
    """
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, spans = removal_spans(spread(texts.where("doc_id is not null"), "doc_id"), size)
    copies = rows.where(F.col("copy") & (F.col("n_words") >= size)).groupBy("doc_id").agg(F.collect_set("node").alias("copies"))
    told = next(n for n in ("_found" + "_" * k for k in range(len(documents.columns) + 1)) if n not in documents.columns)
    found = written(spans.join(copies, "doc_id", "full_outer").select(
        F.col("doc_id").alias(key), F.struct("spans", "node", "copies").alias(told)), "found")
    held = found.agg(F.sum(8 * F.coalesce(F.size(f"{told}.spans"), F.lit(0)) + 64)).first()[0] or 0
    both = documents.join(F.broadcast(found) if held <= BROADCAST_BYTES else found, key, "left").select(*documents.columns, told)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in rolling.slices(batch, text):
                words = rolling.cut_words(data, offsets, rolling.GRAPHIC)
                node = _node(words)
                told = part.column(part.num_columns - 1).to_pylist()
                kept = part.column(part.schema.names.index(text)).to_pylist()
                for i, f in enumerate(told):
                    if f and f["copies"] and int(node[i]) in f["copies"]:
                        kept[i] = ""
                    elif f and f["spans"] and f["node"] == node[i]:
                        kept[i] = _without(words, i, np.array(f["spans"]).reshape(-1, 2)).decode()
                columns = [pa.array(kept, pa.string()) if name == text else part.column(k) for k, name in enumerate(part.schema.names[:-1])]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    return both.mapInArrow(cut, documents.schema)
