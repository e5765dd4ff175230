"""An FM-index over sequences of word numbers: suffix order, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: The most symbols in one index: ranks and places then fit in 20 bits each of a sort key.
MAX_SYMBOLS = (1 << 20) - 2
_SHIFT = 20
_LOW = np.int64((1 << _SHIFT) - 1)


def suffix_order(seq: np.ndarray, longest: int) -> np.ndarray:
    """Places in order of their suffixes, where a suffix ends with the first 0 and equal ones go by place.

    longest: the most symbols between two zeros. By prefix doubling; each round sorts only the suffixes
    that are still tied and have not ended.
    """
    n = len(seq)
    place = np.arange(n, dtype=np.int64)
    zero = np.where(seq == 0, place, n)
    until = np.minimum.accumulate(zero[::-1])[::-1] - place  # symbols before the suffix's end
    order = np.sort((seq.astype(np.int64) << _SHIFT) | place)
    suffixes = order & _LOW
    symbol = order >> _SHIFT
    fresh = np.append(True, symbol[1:] != symbol[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[suffixes] = np.maximum.accumulate(np.where(fresh, place, 0))
    rank[n] = 0
    known = 1
    sizes = np.diff(np.append(np.flatnonzero(fresh), n))
    tied = suffixes[(np.repeat(sizes, sizes) > 1) & (symbol > 0)]
    while len(tied) and known < 2 * longest:
        follow = np.where(until[tied] > known, rank[np.minimum(tied + known, n)] + 1, 0)
        keys = np.sort((rank[tied] << (2 * _SHIFT)) | (follow << _SHIFT) | tied)
        group, member = keys >> (2 * _SHIFT), keys & _LOW
        at = np.arange(len(keys))
        slot = group + at - np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
        suffixes[slot] = member
        both = keys >> _SHIFT
        fresh = np.append(True, both[1:] != both[:-1])
        rank[member] = np.maximum.accumulate(np.where(fresh, slot, 0))
        known *= 2
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(keys)))
        tied = member[(np.repeat(sizes, sizes) > 1) & (until[member] >= known)]
    return suffixes


class _Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))[:-1]
        self.zeros = int(len(bits) - self.rank(np.array([len(bits)]))[0])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletMatrix:
    """Access and rank over symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels: list[_Bits] = []
        for k in reversed(range(levels)):
            bits = (symbols >> k) & 1 > 0
            self.levels.append(_Bits(bits))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place i."""
        start = np.zeros_like(i)
        for k, level in zip(reversed(range(len(self.levels))), self.levels, strict=True):
            one = (symbol >> k) & 1 > 0
            a, b = level.rank(start), level.rank(i)
            start, i = np.where(one, level.zeros + a, start - a), np.where(one, level.zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it stands before."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for level in self.levels:
            one = level.get(i)
            a, b = level.rank(start), level.rank(i)
            start, i = np.where(one, level.zeros + a, start - a), np.where(one, level.zeros + b, i - b)
            symbol = symbol * 2 + one
        return symbol, i - start


class FMIndex:
    """seq: symbols from 1; zeros end sequences, and the last symbol is 0."""

    def __init__(self, seq: np.ndarray, symbols: int, longest: int, step: int = 16) -> None:
        if len(seq) > MAX_SYMBOLS or not len(seq) or seq[-1]:
            raise ValueError("an index takes 1 to MAX_SYMBOLS symbols that end with 0")
        suffixes = suffix_order(seq, longest)
        levels = max(1, int(symbols).bit_length())
        previous = seq[suffixes - 1]
        self.wavelet = WaveletMatrix(previous, levels)
        counts = np.bincount(seq, minlength=symbols + 1)
        self.first = np.append(0, np.cumsum(counts))  # of suffixes that start with a smaller symbol
        sampled = (suffixes % step == 0) | (previous == 0)  # a walk never crosses the end of a sequence
        self.sampled = _Bits(sampled)
        self.samples = suffixes[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, padded with 0) together: the intervals' starts and ends."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.first[-1], np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(hi[live] > lo[live])]
            now = live[lengths[live] >= back]
            if not len(now):
                break
            symbol = phrases[now, lengths[now] - back].astype(np.int64)
            lo[now] = self.first[symbol] + self.wavelet.rank(symbol, lo[now])
            hi[now] = self.first[symbol] + self.wavelet.rank(symbol, hi[now])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows: walk back to the next sampled one."""
        out = np.empty(len(rows), np.int64)
        rows, at, walked = rows.astype(np.int64), np.arange(len(rows)), 0
        while len(rows):
            hit = self.sampled.get(rows)
            out[at[hit]] = self.samples[self.sampled.rank(rows[hit])] + walked
            rows, at = rows[~hit], at[~hit]
            if len(rows):
                symbol, before = self.wavelet.access(rows)
                rows = self.first[symbol] + before
                walked += 1
        return out
