"""CSV files with quoted newlines, cut anywhere."""

import numpy as np
import pyarrow as pa
import pytest

from lexsieve.sources import csv_records as cr

TEXT = 'a,"b ""x""\ny",c\n1,"two\n\nlines ""q""\n, end",3\n,"",z\n\n"é\n",5,6\n"""",8,"9\n""\n"\n'
OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "mode": "FAILFAST"}


def plain_records(text):
    """Records of a text, character by character."""
    out, now, inside = [], "", False
    for ch in text:
        inside ^= ch == '"'
        if ch == "\n" and not inside:
            out.append(now)
            now = ""
        else:
            now += ch
    return out + [now] * bool(now)


def cut_at(text, cuts, rows_per_batch):
    """What the tasks and the joining of pieces make of a text whose blocks start at ``cuts``."""
    lines, at = [], 0
    for line in text.split("\n")[:-1] if text.endswith("\n") else text.split("\n"):
        lines.append((max(c for c in cuts if c < at or c == 0), line))  # a line at a border is the earlier block's
        at += len(line) + 1
    inside, before = {}, 0
    for block, line in lines:
        inside.setdefault(block, before % 2 == 1)
        before += line.count('"')
    batches = [pa.RecordBatch.from_pydict({
        "value": [x for _, x in part], "file": ["f"] * len(part), "block": [b for b, _ in part],
        "quotes": np.array([x.count('"') for _, x in part]), "inside": [inside[b] for b, _ in part]})
        for part in (lines[i:i + rows_per_batch] for i in range(0, len(lines), rows_per_batch))]
    rows = [r for b in cr._cut(iter(batches)) for r in b.to_pylist()]
    assert [r["header"] for r in rows] == [i == 0 for i in range(len(rows))]
    got, open_record = [], []
    for r in rows:  # rows of one task come in file order
        open_record.append(r["record"])
        if r["kind"] in ("whole", "head"):
            assert r["kind"] == "head" or len(open_record) == 1
            got.append("\n".join(open_record))
            open_record = []
    assert not open_record
    return got


@pytest.mark.parametrize("rows_per_batch", [1, 2, 5, 100])
def test_blocks_may_start_at_any_character(rows_per_batch):
    want = plain_records(TEXT)
    for i in range(1, len(TEXT)):
        assert cut_at(TEXT, [0, i], rows_per_batch) == want
        assert cut_at(TEXT, [0, i, min(i + 9, len(TEXT))], rows_per_batch) == want
    assert cut_at(TEXT, list(range(len(TEXT))), rows_per_batch) == want
    assert cut_at(TEXT[:-1], [0, 20], rows_per_batch) == want


@pytest.fixture()
def small_blocks(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("size, broadcast_bytes", [(1000, None), (61, None), (41, 0)])
def test_rows_equal_the_plain_reader(spark, tmp_path, small_blocks, size, broadcast_bytes):
    for name, text in (("a", TEXT), ("b", TEXT.replace("z", "w")), ("empty", ""), ("header", "a,b,c\n")):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    plain = spark.read.options(**OPTIONS).schema("a string, b string, c string").csv(str(tmp_path))
    want = rows_of(plain)
    assert len(want) == 8
    small_blocks(size)
    assert rows_of(cr.read_csv(spark, str(tmp_path), ["a", "b", "c"], broadcast_bytes)) == want


def test_carriage_returns_open_quotes_wide_records_and_no_files(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("﻿a,b\r\n1,\"x\r\ny\"\r\n2,\r\n".encode())
    assert rows_of(cr.read_csv(spark, str(path), ["a", "odd `name`"])) == [repr(("1", "x\ny")), repr(("2", None))]
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        cr.read_csv(spark, str(path), ["a", "b"]).collect()
    path.write_text('a,b\n1,"2\n')
    with pytest.raises(ValueError, match="inside a quoted value"):
        cr.read_csv(spark, str(path), ["a", "b"])
    path.write_text("")
    assert rows_of(cr.read_csv(spark, str(path), ["a", "b"])) == []
