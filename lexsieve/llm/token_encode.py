"""Exact tokenizer ids for Arrow text batches, with each distinct chunk encoded once.

A text is cut where the tokenizers' own pre-split always cuts: before a lone space or line feed between two
visible characters, and between an ASCII letter and ASCII punctuation other than an apostrophe. Nothing that the
tokenizers match spans such a place, so the ids of the chunks in order are the ids of the text. Distinct chunks
of a slice of texts are looked up by hash in a bounded cache of the worker; only new ones reach the tokenizer,
many in one call, parted by a special token. The cache has two generations: when the younger is full it becomes the
older one, and chunks that are met again move on, so common chunks stay however many rare ones pass.

Holds for tokenizers that never merge across white space and whose pre-split parts letters from punctuation
(word-end BPE and byte-level BPE with leading spaces). `folds` says that the tokenizer lower-cases and drops
white space, so chunks that differ only there share an entry.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from lexsieve.llm import rolling

#: Chunks that a worker remembers, in both generations together (some 35 bytes each).
CACHE_CHUNKS = 2_000_000
#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20
_CALL_CHUNKS = 4_000

_VISIBLE = np.array([0x21 <= b <= 0x7E for b in range(256)])
_LEAD_TWO = np.array([0xC3 <= b <= 0xDF for b in range(256)])
_NEXT = _VISIBLE | _LEAD_TWO | np.array([0xE4 <= b <= 0xF4 for b in range(256)])
_BLANK = np.isin(np.arange(256), (0x20, 0x0A))
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_MARK = np.isin(np.arange(256), list(b".,!?:;%$&#*()\"-"))


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the chunks of all documents, ascending."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        before = _VISIBLE[data[:-2]].copy()
        before[1:] |= (data[1:-2] >= 0x80) & (data[1:-2] < 0xC0) & _LEAD_TWO[data[:-3]]
        cut[1:-1] = _BLANK[data[1:-1]] & before & _NEXT[data[2:]]
    if n > 1:
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    # a cut needs its neighbours in the same document
    inner = offsets[1:-1]
    for place in (inner, inner - 1, inner + 1):
        cut[place[(place >= 0) & (place < n)]] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class _Chunks:
    """Ids of chunks by hash: hashes ascending, with the place of each chunk's ids in one array."""

    def __init__(self) -> None:
        self.codes, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self._ids, self._used = np.zeros(1 << 18, np.uint32), 0

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where there is none."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks at these positions in a row, and their bounds."""
        size = self.size[at].astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(size)))
        return self._ids[np.repeat(self.begin[at] - bounds[:-1], size) + np.arange(bounds[-1])], bounds

    def add(self, codes: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Take in chunks that are not there yet, hashes ascending."""
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
        self._ids[self._used:self._used + len(ids)] = ids
        at = np.searchsorted(self.codes, codes)
        self.codes = np.insert(self.codes, at, codes)
        self.begin = np.insert(self.begin, at, self._used + bounds[:-1])
        self.size = np.insert(self.size, at, np.diff(bounds))
        self._used += len(ids)


@dataclass
class ChunkEncoder:
    """One tokenizer file with its cache."""

    path: str
    folds: bool
    separator: str = "<|endoftext|>"
    cache: int = CACHE_CHUNKS
    _young: _Chunks = field(default_factory=_Chunks)
    _old: _Chunks = field(default_factory=_Chunks)

    def __post_init__(self) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(self.path)
        self._separator_id = self._tokenizer.token_to_id(self.separator)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and their bounds."""
        found, sizes = [], []
        for at in range(0, len(texts), _CALL_CHUNKS):
            part = texts[at:at + _CALL_CHUNKS]
            apart = [i for i, t in enumerate(part) if "<|" in t]  # may hold a special token
            ids = self.plain(self.separator.join("" if "<|" in t else t for t in part) if apart else self.separator.join(part))
            cuts = np.flatnonzero(ids == self._separator_id)
            size = np.diff(cuts, prepend=-1, append=len(ids)) - 1
            ids = np.delete(ids, cuts)
            ends = np.cumsum(size)
            for i in reversed(apart):  # these were left blank
                own = self.plain(part[i])
                ids, size[i] = np.insert(ids, ends[i], own), len(own)
            found.append(ids)
            sizes.append(size)
        return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and the bounds of each document in them."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        if 2 * len(self._young.codes) >= self.cache:
            self._old, self._young = self._young, _Chunks()
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        if self.folds:
            low = rolling.LOWER[data]
            code = rolling.byte_hashes(low, starts + (_BLANK[data[starts]] & (ends - starts > 1)), ends)
            bars = np.concatenate(([0], np.cumsum(data == 0x7C)))
            raw = np.flatnonzero(bars[ends] > bars[starts])  # a special token is told by its case
            code[raw] = rolling.mix(rolling.byte_hashes(data, starts[raw], ends[raw]))
        else:
            code = rolling.byte_hashes(data, starts, ends)
        distinct, where, back = np.unique(code, return_index=True, return_inverse=True)
        new = np.flatnonzero(self._young.find(distinct) < 0)
        before = self._old.find(distinct[new])
        if (before >= 0).any():
            self._young.add(distinct[new[before >= 0]], *self._old.ids(before[before >= 0]))
            new = new[before < 0]
        if len(new):
            raw = data.tobytes()
            self._young.add(distinct[new], *self._encode([raw[a:b].decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]))
        ids, bounds = self._young.ids(self._young.find(distinct)[back])
        return ids, bounds[np.searchsorted(starts, offsets, side="left")]


_ENCODERS: dict[tuple[str, bool, int], ChunkEncoder] = {}


def encoder(path: str, folds: bool, cache: int = CACHE_CHUNKS) -> ChunkEncoder:
    """The worker's encoder of a tokenizer file that remembers `cache` chunks."""
    own = path, folds, cache
    if own not in _ENCODERS:
        _ENCODERS[own] = ChunkEncoder(path, folds, cache=cache)
    return _ENCODERS[own]
