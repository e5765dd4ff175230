"""Periodic runs of words: every maximal stretch that repeats itself with some smallest period.

A run of period q is a stretch of consecutive words in which words q apart are equal, which no neighbouring
word extends, and which holds at least two periods and LEAST words. In a run any GRAM words recur q words further
on or back, but for up to GRAM - 1 places in its middle. So a text is first cut to stretches of words in which, with gaps
no longer than that, all GRAM words recur, by hashes of a whole batch of texts in numpy. This loses nothing, as equal words
have equal hashes; what has no such stretch has no run.

In each stretch the longest Lyndon word at every place is found by a stack scanned from right to left, under an
order of the words and under its inverse: each run has a Lyndon word of its period's length for one of the two.
Two places are compared by the length that they have in common, a binary search over rolling hashes whose result
is verified word by word (and counted directly where a hash was wrong); what is verified of two places so many words apart is
remembered, so no part of a stretch is verified twice. The same comparison to the right and to the left extends each Lyndon
word to its run. There is no suffix array.

Cases: a null text has no words, and a text of fewer than LEAST words no runs. Very long texts are searched
whole, one at a time, in one task. Equal rows give equal results, as nothing outside the row counts. An empty table gives
an empty one. Clashing columns of the input are replaced; others pass through. Null ids are not looked at.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 12
#: Words that recur one period further on in any run: LEAST - q of them for periods of up to LEAST / 2, else q.
GRAM = LEAST - LEAST // 2
#: Bytes of text that are cut into words together; a longer text goes alone.
PIECE = 4 << 20
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _again(h: np.ndarray) -> np.ndarray:
    """Which values stand more than once."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def stretches(ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the stretches that may hold runs, among the words of several texts."""
    if len(ids) < LEAST:
        return []
    values, grams = _mix(ids.astype(np.uint64) + np.uint64(1)), np.zeros(len(ids) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(_STEP) + values[k : k + len(grams)]
    at, group = np.flatnonzero(owner[: len(grams)] == owner[GRAM - 1 :]), owner
    for _ in range(3):  # repeats within a text, then within a stretch of these
        at = at[_again(_mix(grams[at] + _mix(group[at].astype(np.uint64))))]
        if not len(at):
            return []
        head = np.append(True, (np.diff(at) > GRAM) | (owner[at[1:]] != owner[at[:-1]]))
        group = np.zeros(len(ids), np.int64)
        group[at] = np.cumsum(head)
    first, last = at[head], at[np.append(head[1:], True)]
    return [(int(a), int(b) + GRAM) for a, b in zip(first, last, strict=True) if b + GRAM - a >= LEAST]


class _Stretch:
    """Common lengths of the words from or before two places."""

    def __init__(self, ids: np.ndarray) -> None:
        self.words, self.raw, self.size = ids.tolist(), ids.astype("<i4").tobytes(), len(ids)
        powers = np.append(np.uint64(1), np.multiply.accumulate(np.full(len(ids), _STEP, np.uint64)))
        values = _mix(ids.astype(np.uint64) + np.uint64(1))
        self.sums = np.append(np.uint64(0), np.add.accumulate(values * powers[:-1])).tolist()
        self.powers = powers.tolist()
        self.known: dict[int, tuple[int, int]] = {}  # by distance, the words last found equal to those so far on

    def _equal(self, i: int, j: int, n: int) -> bool:
        s = self.sums
        return ((s[i + n] - s[i]) * self.powers[j - i] - s[j + n] + s[j]) & _MASK == 0

    def _most(self, limit: int, equal) -> int:
        """The greatest n up to limit with equal(n), which holds up to it: steps that double, then halving."""
        low, step = 1, 2
        while step <= limit and equal(step):
            low, step = step, step * 2
        high = min(step - 1, limit)
        while low < high:
            n = (low + high + 1) // 2
            if equal(n):
                low = n
            else:
                high = n - 1
        return low

    def _verified(self, i: int, j: int, n: int, back: bool = False) -> int:
        """How many of n words at i and at j are equal indeed, from the left or from the right."""
        if self.raw[4 * i : 4 * (i + n)] == self.raw[4 * j : 4 * (j + n)]:
            return n
        pairs = range(n - 1, -1, -1) if back else range(n)
        return next(k for k, x in enumerate(pairs) if self.words[i + x] != self.words[j + x])

    def after(self, i: int, j: int) -> int:
        """Words in common from i and j > i on."""
        w = self.words
        if j >= self.size or w[i] != w[j]:
            return 0
        lo, hi = self.known.get(j - i, (-1, -1))
        if lo <= i < hi:
            return hi - i
        limit = lo - i if i < lo else self.size - j
        n = self._verified(i, j, self._most(limit, lambda n: self._equal(i, j, n)))
        end = hi if i + n == lo else i + n
        self.known[j - i] = i, end
        return end - i

    def before(self, i: int, j: int) -> int:
        """Words in common that end before i and j > i."""
        w = self.words
        if i == 0 or w[i - 1] != w[j - 1]:
            return 0
        n = self._most(i, lambda n: self._equal(i - n, j - n, n))
        return self._verified(i - n, j - n, n, True)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one stretch of words, by start, then period."""
    text = _Stretch(ids)
    w, n, after = text.words, text.size, text.after
    found, seen = [], {}  # by period, the last words found equal to those a period on, as far as they reach
    for inverse in (False, True):
        following = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                a, b = w[i], w[j]
                if a == b:
                    k = after(i, j)
                    if j + k == n:
                        break
                    a, b = w[i + k], w[j + k]
                if (a < b) == inverse:
                    break
                j = following[j]
            following[i] = j
            if j == n:
                p = n - i
                if 2 * p > n:
                    continue
            else:
                p = j - i
            lo, hi = seen.get(p, (0, -1))
            if lo <= i <= hi:
                continue
            lo, hi = i - text.before(i, j), i + after(i, j)
            seen[p] = lo, hi
            if hi - lo >= max(p, LEAST - p):
                found.append((lo, hi - lo + p, p))
    return sorted(set(found), key=lambda x: (x[0], x[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """What is left without the words that some run holds after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    keep = np.cumsum(cover)[:-1] == 0
    return b" ".join([x for x, k in zip(words, keep.tolist(), strict=True) if k])


def search(texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Of each text: words, runs, and the text without repetitions."""
    out = []
    for lo, hi in common.slices(texts, PIECE):
        words = [(t or b"").split() for t in texts[lo:hi]]
        order: dict[bytes, int] = {}
        ids = np.fromiter((order.setdefault(x, len(order)) for x in chain.from_iterable(words)), np.int64)
        sizes = [len(x) for x in words]
        owner, begins = np.repeat(np.arange(len(words)), sizes), np.append(0, np.cumsum(sizes))
        runs: list[list] = [[] for _ in words]
        for a, b in stretches(ids, owner):
            k = int(owner[a])
            runs[k] += [(a - int(begins[k]) + s, length, p) for s, length, p in runs_of(ids[a:b])]
        out += [(len(x), sorted(r, key=lambda y: (y[0], y[2])), collapsed(x, r)) for x, r in zip(words, runs, strict=True)]
    return out


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed_text."""
    common.bound_batches(docs.sparkSession)
    docs = common.without(docs, "n_words", "runs", "collapsed_text")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @F.arrow_udf("n long, runs array<struct<start: long, length: long, period: long>>, rest string")
    def searched(texts: pa.Array) -> pa.Array:
        found = search(common.as_bytes(texts))
        flat = np.array([x for _, r, _ in found for x in r], np.int64).reshape(-1, 3)
        offsets = np.append(0, np.cumsum([len(r) for _, r, _ in found])).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run)))
        rest = pa.array([x for *_, x in found], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([pa.array([n for n, *_ in found], pa.int64()), listed, rest], names=["n", "runs", "rest"])

    found = docs.withColumn("__r", searched(F.col(text)))
    return found.select(*[f"`{c}`" for c in docs.columns], F.col("__r.n").alias("n_words"), F.col("__r.runs").alias("runs"), F.col("__r.rest").alias("collapsed_text"))
