"""Vectorised word and window hashing of Arrow text batches.

A batch of texts is one byte buffer with document offsets. Words are runs of member bytes inside one
document; their Rabin-Karp hashes come from one prefix sum over the buffer, window hashes from a second
prefix sum over the word hashes. Everything is modulo 2^64 with odd bases, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240607)
_BYTE_CODE = _SEED.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes kept in one slice of work; a longer document is a slice of its own. One less than a power of two, so
#: that the tables of powers, which have an entry more, are no larger.
SLICE_BYTES = (1 << 18) - 1


def mix(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher: spreads a modular sum over all bits."""
    v = values ^ (values >> np.uint64(30))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v = v * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        forward = np.full(size, base, np.uint64)
        backward = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        forward[0] = backward[0] = 1
        have = (np.cumprod(forward, dtype=np.uint64), np.cumprod(backward, dtype=np.uint64))
        if size <= 1 << 22:  # larger tables serve one long document and are not kept
            _POWERS[base] = have
    return have


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of codes[start:end] for each range."""
    forward, backward = _powers(base, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * forward[: len(codes)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * backward[starts])


@dataclass
class Words:
    """Words of some documents: byte ranges in `data`, document of each, and their hashes."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of the first word of each document, one more entry at the end."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)), side="left")

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def cut_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """Maximal runs of bytes with member[byte], never across two documents."""
    inside = member[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    inner = offsets[(offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[offsets > 0] - 1
    after[last[last < len(data)]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, offsets, starts, ends, doc, range_hashes(_BYTE_CODE[data], starts, ends, _BYTE_BASE))


def window_hashes(words: Words, size: int, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of `size` words that lies in one document."""
    codes = words.hashes if codes is None else codes
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[:n] == words.doc[size - 1:])
    return at, range_hashes(codes, at, at + size, _WORD_BASE)


def range_windows(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window of `size` codes from each place of `at`."""
    return range_hashes(codes, at, at + size, _WORD_BASE)


def sequence_hashes(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of the whole code sequence between consecutive bounds."""
    return range_hashes(codes, bounds[:-1], bounds[1:], _WORD_BASE)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(_BYTE_CODE[data], starts, ends, _BYTE_BASE)


def member_bytes(separators: bytes) -> np.ndarray:
    """Membership table of all bytes but the given ones."""
    member = np.ones(256, bool)
    member[list(separators)] = False
    return member


#: Words between ASCII white space.
GRAPHIC = member_bytes(b" \t\n\x0b\x0c\r")
#: Letters, digits and all bytes of non-ASCII characters.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: The same after lower-casing A-Z.
LOWER_ALNUM = np.array([b >= 128 or chr(b).isdigit() or 97 <= b <= 122 for b in range(256)])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.cast(pa.large_binary()).fill_null(b"")
    raw = wide.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = np.frombuffer(raw[2], np.uint8)[offsets[0]:offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch whose texts hold about `limit` bytes at most, with their buffers."""
    data, offsets = text_buffer(batch.column(batch.schema.names.index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to
