"""Fuzzy scores: substring (a column expression), then spread-out characters and misspellings (an Arrow UDF).

Scores work on UTF-8 bytes of folded text. A literal hit scores .75 and more, by its share of the field
and where it starts. Otherwise a pattern of several words is scored word by word. A word scores .45 to
.74 for its bytes in order but apart, or else up to .74 by edit distance (adjacent swaps are one edit).
Only rows without a literal hit reach the UDF with a text; the others pass it a null.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR, CEILING, LEAST_TYPO, MOST_TYPO = 0.45, 0.74, 4, 64
#: The bytes that part words.
BOUNDARIES = b" \t\0-_/\\.,()[]&"
_SPLIT = re.compile(b"[" + re.escape(BOUNDARIES) + b"]+")


def substring_score(text: Column, pattern: str, start: bool = False, end: bool = False) -> Column:
    """Score of a literal hit, else 0."""
    n = len(pattern.encode())
    at = F.lit(1) if start else F.char_length(text) - len(pattern) + 1 if end else F.instr(text, pattern)
    hit = (text == pattern) if start and end else text.startswith(pattern) if start else text.endswith(pattern) if end else at > 0
    before = F.substring(text, at - 1, F.lit(1))
    bonus = F.when(at == 1, 0.10).when(before.isin(*[chr(b) for b in BOUNDARIES]), 0.05).otherwise(0.0)
    return F.when(hit, F.least(F.lit(1.0), F.lit(0.75) + F.lit(0.15) * n / F.octet_length(text) + bonus)).otherwise(0.0)


def spread_score(text: bytes, pattern: bytes, start: bool = False, end: bool = False) -> float:
    """The pattern's bytes in order, each at its first place after the one before."""
    places, at = [], -1
    for byte in pattern:
        at = text.find(byte, at + 1)
        if at < 0:
            return 0.0
        places.append(at)
    if (start and places[0] != 0) or (end and places[-1] != len(text) - 1):
        return 0.0
    heads = [p for k, p in enumerate(places) if k == 0 or p != places[k - 1] + 1]
    at_words = sum(p == 0 or text[p - 1] in BOUNDARIES for p in heads)
    m = len(pattern)
    together = (m - len(heads)) / (m - 1) if m > 1 else 1.0
    score = 0.35 + 0.25 * together + 0.10 * at_words / len(heads) + 0.05 * m / len(text)
    return 0.0 if score < FLOOR else min(score, CEILING)


def osa_distance(a: bytes, b: bytes, most: int) -> int | None:
    """Optimal string alignment distance, or None if it is over most."""
    if abs(len(a) - len(b)) > most:
        return None
    older: list[int] = []
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return None
        older, above = above, row
    return above[-1] if above[-1] <= most else None


def typo_score(text: bytes, pattern: bytes, start: bool = False, end: bool = False) -> float:
    """By the fewest edits to the text, one of its words or, anchored, an end of about the pattern's length."""
    m = len(pattern)
    if not LEAST_TYPO <= m <= MOST_TYPO:
        return 0.0
    most = 1 + (m >= 7) + (m >= 10)
    if start and end:
        choices = {text}
    elif start or end:
        sizes = [n for n in range(m - most, m + most + 1) if 0 < n <= len(text)]
        choices = {text[:n] if start else text[-n:] for n in sizes}
    else:
        choices = {text, *filter(None, _SPLIT.split(text))}
    found = [d for d in (osa_distance(c, pattern, most) for c in choices) if d is not None]
    if not found:
        return 0.0
    score = 0.20 + 0.50 * (1 - min(found) / m)
    return 0.0 if score < FLOOR else min(score, CEILING)


def literal_score(text: bytes, pattern: bytes, start: bool = False, end: bool = False) -> float:
    """substring_score of bytes."""
    at = 0 if start else len(text) - len(pattern) if end else text.find(pattern)
    hit = text == pattern if start and end else text.startswith(pattern) if start else text.endswith(pattern) if end else at >= 0
    if not hit:
        return 0.0
    return min(1.0, 0.75 + 0.15 * len(pattern) / len(text) + (0.10 if at == 0 else 0.05 if text[at - 1] in BOUNDARIES else 0.0))


def word_score(text: bytes, word: bytes, start: bool, end: bool) -> float:
    return literal_score(text, word, start, end) or spread_score(text, word, start, end) or typo_score(text, word, start, end)


def score(text: bytes, pattern: bytes, start: bool = False, end: bool = False) -> float:
    """All tiers, for one text."""
    if not pattern or not text:
        return float(pattern == text)
    if found := literal_score(text, pattern, start, end):
        return found
    words = pattern.split()
    if len(words) < 2:
        return word_score(text, pattern, start, end) if words else 0.0
    each = [word_score(text, w, start and k == 0, end and k == len(words) - 1) for k, w in enumerate(words)]
    return min(sum(each) / len(each), CEILING) if all(each) else 0.0


def fuzzy_score(text: Column, pattern: str, start: bool = False, end: bool = False) -> Column:
    """Score of a folded column against a folded pattern."""
    if not pattern:
        return (text == "").cast("double")
    literal = substring_score(text, pattern, start, end)
    raw = pattern.encode()

    @F.arrow_udf("double")
    def further(texts: pa.Array) -> pa.Array:
        known = lru_cache(1 << 16)(lambda t: score(t.encode(), raw, start, end))
        return pa.array([None if t is None else known(t) for t in texts.to_pylist()], pa.float64())

    return F.coalesce(further(F.when(literal == 0, text)), literal)


def possible(text: Column, pattern: str) -> Column:
    """Whether a text may score at all: it needs every letter of every word of the pattern, but for as many as a misspelling may change.

    This runs in the JVM and loses nothing: bytes in order are all there, and an edit takes away one of them at most.
    """
    out = F.lit(True)
    for word in pattern.split():
        if word.isascii():
            m = len(word)
            most = 1 + (m >= 7) + (m >= 10) if LEAST_TYPO <= m <= MOST_TYPO else 0
            letters = sorted(set(word))
            if len(letters) > most:
                out = out & (sum((F.contains(text, F.lit(c)).cast("int") for c in letters), F.lit(0)) >= len(letters) - most)
    return out


def further_score(text: Column, pattern: str, start: bool = False, end: bool = False) -> Column:
    """Score of a text that has no literal hit, for a column of distinct values; 0 where it has one."""
    raw = pattern.encode()

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else score(t.encode(), raw, start, end) for t in texts.to_pylist()], pa.float64())

    # said to be nondeterministic, as filters on the score are else moved below distinct, and every row is scored
    return F.coalesce(run.asNondeterministic()(F.when(substring_score(text, pattern, start, end) == 0, text)), F.lit(0.0))


def register(spark) -> None:
    """SQL functions: fuzzy_score(folded text, folded pattern), osa_distance(a, b)."""

    @F.arrow_udf("double")
    def both(texts: pa.Array, patterns: pa.Array) -> pa.Array:
        return pa.array([None if t is None or p is None else score(t.encode(), p.encode()) for t, p in zip(texts.to_pylist(), patterns.to_pylist(), strict=True)], pa.float64())

    @F.arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else osa_distance(x.encode(), y.encode(), len(x) + len(y) + 99) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    spark.udf.register("fuzzy_score", both)
    spark.udf.register("osa_distance", distance)
