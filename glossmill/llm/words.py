"""Array kernels over the UTF-8 bytes of a batch of texts.

Every word class used here is delimited by ASCII bytes, so a batch is split and hashed on
its bytes, without a Python object for a word. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
#: Words longer than this are hashed one by one.
_LONG = 256


def _table(delimiters: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(delimiters)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z became a-z
ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a batch: byte spans in ``data``, and where each document's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array | pa.ChunkedArray, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, offsets = utf8(texts)
    if lower:
        data = _LOWER[data]
    inside = table[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _K3
    h = (h ^ (h >> _U(29))) * _K2
    return h ^ (h >> _U(32))


def hashes(words: Words) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    size = words.ends - words.starts
    h = size.astype(_U) * _K1
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    live, at = np.flatnonzero(size <= _LONG), 0
    while len(live):
        rest = size[live] - at
        piece = eight[words.starts[live] + at]
        short = rest < 8
        piece[short] &= (_U(1) << (rest[short].astype(_U) * _U(8))) - _U(1)
        x = (h[live] ^ (piece * _K2)) * _K1
        h[live] = x ^ (x >> _U(31))
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(words.text(i), digest_size=8).digest(), "little")
    return mix(h)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions have none."""
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, _U)
    for j in range(k):
        g = g * _K1 + h[j : j + n]
    return mix(g)


def gram_starts(offsets: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k words stay in one document."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(counts.sum())


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def least(h: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of one document: its start, and the place and hash of its least k-gram (the last of equal ones)."""
    starts = gram_starts(offsets, window)
    if not len(starts):
        return starts, starts, np.empty(0, _U)
    g = grams(h, k)
    best, where = g[starts].copy(), starts.copy()
    for j in range(1, window - k + 1):
        other = g[starts + j]
        less = other <= best
        best[less], where[less] = other[less], starts[less] + j
    return starts, where, best


def small(batches, column: str = "text", limit: int = 4 << 20):
    """Batches cut to about ``limit`` bytes of text each, or one whole row where it has more."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, to - row)
            row = to
