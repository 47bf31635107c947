"""Chunk encoder, token store and packing against the tokenizer and exact searches."""

import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexsieve.llm import packing, rolling, token_encode, token_store
from lexsieve.plans.scale import new_folder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["a b", "<|endoftext|>", "x<|endoftext|> y <|STARTOFTEXT|> <|StartOfText|>", "don't  do 's 's it's", " a  b", "é. è! Ñ ñ", "a\n\nb \n c",
         "日本 語 テスト", "é ́x Å", "İstanbul ΣΑΣ Σ", "", "  ", "3.5kg, 1,000 x'S 'LL", "A\tb\r\nc", "　x y z q", "😀 😀ab ,.; ''s",
         "word% %%% *** a*b*c (x) \"q\" -y", "KK ² ½½ ١٢", "a b c", "b ", " x", "a\n", "\nb", "Lone The the THE"]


@pytest.mark.parametrize(("path", "folds"), [(WORD, True), (BYTE, False)])
def test_chunks_give_the_tokenizers_ids(path, folds):
    whole = Tokenizer.from_file(path)
    own = token_encode.ChunkEncoder(path, folds)
    texts = [*NASTY, " ".join(NASTY), "\n".join(NASTY), "".join(NASTY)]
    for cache in (own.cache, own.cache, 0, 0, 8, 200):  # cold, warm, generations changing at every call, and now and then
        own.cache = cache
        ids, bounds = own.encode(*rolling.text_buffer(pa.array(texts)))
        for i, text in enumerate(texts):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_common_chunks_stay_while_rare_ones_pass(monkeypatch):
    own, seen = token_encode.ChunkEncoder(BYTE, False, cache=200), []
    encode = token_encode.ChunkEncoder._encode
    monkeypatch.setattr(token_encode.ChunkEncoder, "_encode", lambda self, texts: seen.extend(texts) or encode(self, texts))
    for k in range(60):
        own.encode(*rolling.text_buffer(pa.array(["the common words " + " ".join(f"rare{k}x{j}" for j in range(20))])))
        assert len(own._young.codes) <= 100 + 24 and len(own._old.codes) <= 124
    assert seen.count(" common") == 1 and seen.count(" rare59x3") == 1


def test_variable_length_code_round_trips():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rng.integers(0, 2**32, n, dtype=np.uint32) >> rng.integers(0, 32, n, dtype=np.uint32)
        control, data = token_store.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and (token_store.decode_ranks(control, data, n) == ranks).all()
    assert token_store.encode_ranks(np.array([0, 255, 256, 1 << 24]))[0] == bytes([0 | 0 << 2 | 1 << 4 | 3 << 6])


def test_store_round_trip(spark, edge_docs, no_docs):
    path = new_folder(spark, "store")
    token_store.write_store(edge_docs, path, WORD, folds=True, end_id=2)
    found = token_store.read_store(spark, path).collect()
    whole, at, want = Tokenizer.from_file(WORD), 0, []
    ids = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [2]
    rows = edge_docs.collect()
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        own = ids(r["text"])
        want.append((r["doc_id"], at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    counts = np.bincount(np.concatenate([ids(r["text"]) for r in rows]))
    assert [r["id"] for r in ranks] == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))
    empty = new_folder(spark, "store")
    token_store.write_store(no_docs, empty, WORD, folds=True, end_id=2)
    assert token_store.read_store(spark, empty).count() == 0


def fewest_bins(lengths, capacity):
    """Smallest number of bins: for every set of pieces the fewest bins and then the least filled last bin."""
    best = [(1, 0)] + [None] * ((1 << len(lengths)) - 1)
    for held in range(1, 1 << len(lengths)):
        options = []
        for i, n in enumerate(lengths):
            if held >> i & 1:
                bins, last = best[held & ~(1 << i)]
                options.append((bins, last + n) if last + n <= capacity else (bins + 1, n))
        best[held] = min(options)
    return best[-1][0]


SPARE = [([994, 994, 926, 811, 444, 444, 444, 350, 313, 313], 2048), ([6, 5, 4, 3, 3, 3], 12), ([1000, 900, 300, 310, 320], 1930)]


def check_packing(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    found = packing.complete_bins(counts, capacity)
    held = np.zeros(capacity + 1, int)
    for filling, times in found.bins:
        assert sum(filling) <= capacity and times > 0
        np.add.at(held, list(filling), times)
    assert (held == counts).all() and found.proved
    assert found.bound <= found.used == fewest_bins(lengths, capacity), lengths
    return found


@pytest.mark.parametrize("alive", [32, 1])
def test_bin_completion_is_optimal_on_500_sets(monkeypatch, alive):
    monkeypatch.setattr(packing, "ALIVE", alive)  # nearly every enumeration is given up and taken up again
    rng = np.random.default_rng(9)
    for lengths, capacity in SPARE:
        check_packing(lengths, capacity)
    above = 0
    for k in range(500):
        n, capacity = int(rng.integers(1, 13)), int(rng.choice([60, 300, 2048]))
        lengths = rng.integers(1, capacity * (0.35 + 0.65 * (k % 3) / 2), n)
        if k % 4 == 0:
            lengths = rng.choice(lengths[:3], n)  # few different lengths, many times
        found = check_packing(sorted(lengths.tolist(), reverse=True), capacity)
        above += found.used > found.bound
    assert above > 0  # sets whose optimum is above the bound are among them, and proved


def test_fillings_are_all_undominated_ones_in_order():
    rng = np.random.default_rng(5)
    for _ in range(60):
        gap = int(rng.integers(5, 40))
        lengths = sorted(rng.integers(1, gap + 5, 7).tolist())
        counts = np.bincount(lengths, minlength=60)
        sets = sorted({tuple(sorted((lengths[i] for i in some), reverse=True)) for k in range(8) for some in combinations(range(7), k)
                       if sum(lengths[i] for i in some) <= gap}, key=lambda f: (sum(f), f), reverse=True)

        def beaten(own):
            left = list(lengths)
            for n in own:
                left.remove(n)
            parts = {(sum(own[i] for i in t), len(t), own[t[0]]) for k in range(1, len(own) + 1) for t in combinations(range(len(own)), k)}
            return any(s <= x <= s + gap - sum(own) and (size > 1 or x != only) for s, size, only in parts for x in left)

        assert list(packing.Fillings(counts, gap)) == [f for f in sets if not beaten(f)]


def test_a_search_that_gives_up_says_so():
    lengths = [994, 994, 926, 811, 444, 444, 444, 350, 313, 313]
    found = packing.complete_bins(np.bincount(lengths, minlength=2049), 2048, nodes=1)
    assert (found.used, found.bound, found.proved) == (4, 3, False)


def test_large_histograms_reach_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, np.exp(rng.normal(5.5, 1.2, 200_000)).astype(int) + 1)
    found = packing.complete_bins(np.bincount(lengths, minlength=2049))
    assert found.used == found.bound and found.proved


def test_packed_sequences(spark, edge_docs, no_docs):
    rows = packing.packed_sequences(edge_docs, BYTE, 0, capacity=256).collect()
    whole, want = Tokenizer.from_file(BYTE), []
    for r in edge_docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        first, at, piece = len(ids) % 256 or 256, 0, 0
        while at < len(ids):
            n = 256 if piece else first
            want.append((r["doc_id"], piece, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())))
            at, piece = at + n, piece + 1
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in rows), key=order) == sorted(want, key=order)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert {(r["sequences"], r["proved"]) for r in rows} == {(len(sequences), True)}
    assert rows[0]["least_sequences"] >= -(-sum(r["length"] for r in rows) // 256)
    assert packing.packed_sequences(no_docs, BYTE, 0).count() == 0
