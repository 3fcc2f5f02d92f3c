"""Compressed FM-index over sequences of words, with matching statistics for streamed ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64


class Wavelet:
    """Wavelet matrix: bit vectors with block counts, a few bytes a symbol, that answer rank."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8 + 8, np.uint8)])
            blocks = packed[: len(packed) // 8 * 8].view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((bit, blocks, before, len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.begin = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, blocks, before, zeros in self.levels:
            at = i >> 6
            ones = before[at] + np.bitwise_count(blocks[at] & ((_U(1) << (i & 63).astype(_U)) - _U(1)))
            i = np.where((c >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` before place ``i``, elementwise."""
        return self._walk(c, i) - self.begin[c]


class Borders:
    """For each depth, a bit vector of the rows whose suffix differs from the row before within that many words.

    Answers where the rows that agree with row ``x`` in their first ``d`` words begin and end.
    Words of 32 bits, and for each the nearest nonempty one on both sides.
    """

    def __init__(self, lcp: np.ndarray, depth: int):
        n = len(lcp)
        places = (n >> 5) + 1
        marks = np.zeros((depth + 1, places * 32), bool)
        for d in range(depth + 1):
            marks[d, :n] = lcp < d
        marks[:, 0] = marks[:, n] = True
        self.blocks = np.packbits(marks, axis=1, bitorder="little").view("<u4")
        at = np.arange(places, dtype=np.int32)
        some = self.blocks != 0
        self.before = np.maximum.accumulate(np.where(some, at, np.int32(-1)), axis=1)
        self.after = np.minimum.accumulate(np.where(some, at, np.int32(places))[:, ::-1], axis=1)[:, ::-1]

    def around(self, x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = x >> 5
        bits = self.blocks[d, b] & ((np.int64(2) << (x & 31)) - 1).astype(np.uint32)
        none = bits == 0
        b[none] = self.before[d[none], b[none] - 1]
        bits[none] = self.blocks[d[none], b[none]]
        low = b * 32 + np.frexp(bits.astype(np.float64))[1] - 1
        y = x + 1
        b = y >> 5
        bits = self.blocks[d, b] & ~((np.int64(1) << (y & 31)) - 1).astype(np.uint32)
        none = bits == 0
        b[none] = self.after[d[none], b[none] + 1]
        bits[none] = self.blocks[d[none], b[none]]
        bits = bits & (~bits + np.uint32(1))
        return low, b * 32 + np.frexp(bits.astype(np.float64))[1] - 1


def coded(passages: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of the words of passages whose words are joined by a blank, where each passage begins, and the number of codes.

    Equal codes are equal words, byte for byte.
    """
    data = b" ".join(passages) + b" "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    begins = np.cumsum([0, *(len(p) + 1 for p in passages)])
    return words.indices.to_numpy().astype(np.int64), np.searchsorted(ends, begins, "right"), len(words.dictionary)


class FMIndex:
    """Index of passages of words, each with a value; it keeps none of their text.

    ``words`` are codes, passage ``i`` has ``words[at[i] : at[i + 1]]``. Suffixes are ordered by
    their first ``depth`` words, as far as matches are measured. Kept are the Burrows-Wheeler transform
    of that order in a wavelet matrix, bit vectors of the borders between suffixes that agree
    less far, and the least value of the suffixes that agree in ``depth`` words.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, values: np.ndarray, depth: int):
        self.depth = depth
        known, dense = np.unique(words, return_inverse=True)
        self.code = np.zeros(int(known[-1]) + 1 if len(known) else 0, np.int64)  # 0: not in the index
        self.code[known] = np.arange(1, len(known) + 1)
        size = np.diff(at)
        text = np.zeros(len(words) + len(size), np.int64)  # a 0 ends each passage
        inside = np.ones(len(text), bool)
        inside[at[1:] + np.arange(len(size))] = False
        text[inside] = dense + 1
        self.size = len(text)
        rank, deep = text, 1
        while deep * 2 <= depth:
            rank, deep = self._pairs(rank, deep), deep * 2
        if deep < depth:
            rank = self._pairs(rank, depth - deep)
        order = np.argsort(rank, kind="stable")
        agree = np.ones(self.size, bool)
        agree[0] = False
        lcp = np.zeros(self.size, np.uint8)
        padded = np.concatenate([text, np.full(depth, -1)])
        for j in range(depth):
            here = padded[order + j]
            agree[1:] &= here[1:] == here[:-1]
            lcp += agree
        self.borders = Borders(lcp, depth)
        self.bwt = Wavelet(text[order - 1], len(known) + 1)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(known) + 1))])
        self.heads = np.flatnonzero(lcp < depth).astype(np.int32)
        self.least = np.minimum.reduceat(np.repeat(values, size + 1)[order], self.heads)

    @staticmethod
    def _pairs(rank: np.ndarray, far: int) -> np.ndarray:
        """Ranks by (rank here, rank ``far`` on)."""
        later = np.zeros(len(rank), np.int64)
        later[:-far] = rank[far:] + 1
        return np.unique(rank * (int(rank.max()) + 2) + later, return_inverse=True)[1]

    def _step(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Backward step: where suffixes that go on as those from ``row`` begin, with ``c`` put before."""
        return self.smaller[c] + self.bwt.rank(c, row)

    def matching_statistics(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of streamed sequences: words that match some passage from there on, up to ``depth``,
        and the least value of the passages that match so far (the largest number where that is less than ``depth``).

        All sequences are read from right to left in step. An interval of suffixes is narrowed by
        a backward step for each word; where that leaves none, the match loses words at its right
        end until it goes on (the most that do are found by bisection over the borders). A
        match of full depth loses its last word before it goes on.
        """
        length, least = np.zeros(len(words), np.int64), np.full(len(words), np.iinfo(np.int64).max)
        c = np.zeros(len(words), np.int64)
        inside = words < len(self.code)
        c[inside] = self.code[words[inside]]
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        sorted_size, ends = -size[order], at[1:][order]
        lo, hi, q = np.zeros(len(size), np.int64), np.full(len(size), self.size), np.zeros(len(size), np.int64)
        for t in range(int(size.max(initial=0))):
            n = int(np.searchsorted(sorted_size, -t, "left"))
            at_t = ends[:n] - 1 - t
            word = c[at_t]
            lo, hi, q = lo[:n], hi[:n], q[:n]
            full = np.flatnonzero(q == self.depth)
            lo[full], hi[full] = self.borders.around(lo[full], np.full(len(full), self.depth - 1))
            q[full] = self.depth - 1
            live = np.flatnonzero(word > 0)
            a, b = self._step(word[live], lo[live]), self._step(word[live], hi[live])
            lost = np.flatnonzero(a >= b)
            if len(lost):
                row, ch = lo[live[lost]], word[live[lost]]
                good, bad = np.zeros(len(lost), np.int64), q[live[lost]].copy()
                while True:
                    open_ = np.flatnonzero(bad - good > 1)
                    if not len(open_):
                        break
                    mid = (good[open_] + bad[open_]) // 2
                    x, y = self.borders.around(row[open_], mid)
                    found = self._step(ch[open_], x) < self._step(ch[open_], y)
                    good[open_[found]], bad[open_[~found]] = mid[found], mid[~found]
                x, y = self.borders.around(row, good)
                a[lost], b[lost] = self._step(ch, x), self._step(ch, y)
                q[live[lost]] = good
            none = word == 0
            lo[none], hi[none], q[none] = 0, self.size, 0
            lo[live], hi[live] = a, b
            q[live] += 1
            length[at_t] = q
            whole = np.flatnonzero(q == self.depth)
            least[at_t[whole]] = self.least[np.searchsorted(self.heads, lo[whole], "right") - 1]
        return length, least
