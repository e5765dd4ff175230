"""Substring dedup by sliding sentence spans.

A text is cut into sentences at marks of punctuation and line ends; a sentence of over LONG words is cut
further after words whose hash divides by four, which depends on nothing but the word itself. Every run of
RUN consecutive sentences is a span, whatever their length, and is hashed from its lower-cased words. In a
document only the first occurrence of a span counts; over all documents the one in the smallest doc_id does.
A sentence covered by any other occurrence goes.

Words, sentences and spans of a whole batch of texts are hashed together in numpy, by differences of running
polynomial sums modulo 2**64. Hashes are pre-aggregated before the shuffle, so a span that stands in a third
of all documents is one row per task; repeated spans are then joined back to their documents (Spark splits
skewed keys), gathered per document, and cut from its text.

Cases: null text stays null; texts of fewer than RUN sentences keep all. Null doc_ids come before all others,
and count as one document with one another, as do rows that share a doc_id: none is a copy of the other,
and what goes from one by place goes from all. An empty table gives an empty one. Long texts are
treated whole. Clashing columns of the input are replaced; others pass through. doc_id is an integer column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN, LONG = 3, 12
MARKS = ".!?\n"
#: An odd multiplier and its inverse modulo 2**64.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_NO_ID = -(1 << 63)
#: Code points that go through numpy together; a longer text goes alone.
PIECE = 1 << 20


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: its lower case where that is one code point, whether words hold it, whether it ends sentences."""
    lower = np.arange(0x110000, dtype=np.uint32)
    word, mark = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum() or x == "_":
            word[c] = True
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
    mark[[ord(c) for c in MARKS]] = True
    return lower, word, mark


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse up to the n-th."""
    if not _powers or len(_powers[0]) <= n:
        _powers[:] = [np.append(np.uint64(1), np.multiply.accumulate(np.full(n, p, np.uint64))) for p in (_STEP, _BACK)]
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of values, equal for equal contents wherever they stand."""
    up, down = _power(len(values))
    sums = np.append(np.uint64(0), np.add.accumulate(values * up[:-1]))
    return mix((sums[ends] - sums[starts]) * down[starts])


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences of the texts, in order: number of the text, place of the first word in it, hash."""
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    lower, word, mark = _tables()
    inside = word[code]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none.astype(np.uint64)
    words = _hashed(lower[code].astype(np.uint64) + np.uint64(1), starts, ends)
    passed = np.cumsum(mark[code])[starts]  # marks before each word; texts are parted by one
    first = np.flatnonzero(np.diff(passed, prepend=-1))  # of each sentence, by word
    sizes = np.diff(np.append(first, len(starts)))
    cut = np.zeros(len(starts), bool)
    cut[1:] = (np.repeat(sizes, sizes) > LONG)[1:] & (words[:-1] % np.uint64(4) == 0)
    cut[first] = True
    first = np.flatnonzero(cut)
    at = starts[first]
    owner = np.searchsorted(begins, at, "right") - 1
    return owner, at - begins[owner], _hashed(words, first, np.append(first[1:], len(starts)))


def spans(owner: np.ndarray, hashes: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(sentence that a span starts at, hash of the span) of every run of sentences of one text."""
    at = np.flatnonzero(owner[: len(owner) - run + 1] == owner[run - 1 :]) if len(owner) >= run else np.zeros(0, np.int64)
    return at, _hashed(hashes, at, at + run)


def parsed(texts: list[str | None], run: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in pieces of bounded size: (from, to, owners, places, sentence number within its text, spans' starts, spans' hashes)."""
    for lo, hi in common.slices(texts, PIECE):
        owner, place, h = sentences([t or "" for t in texts[lo:hi]])
        head = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else owner
        number = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
        yield lo, hi, owner, place, number, *spans(owner, h, run)


def _first(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which spans are the first of their hash in their text."""
    order = np.lexsort((np.arange(len(h)), h, owner))
    a, b = owner[order], h[order]
    out = np.ones(len(h), bool)
    out[order[1:]] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return out


def _found(docs: DataFrame, run: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, owner, _, number, at, h in parsed(batch.column(1).to_pylist(), run):
                own = _first(owner[at], h)
                at, h = at[own], h[own]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[lo + owner[at]]), pa.array(number[at].astype(np.int32))], names=["h", "id", "place"])

    return docs.mapInArrow(each, "h long, id long, place int")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """docs with n_sentences, n_removed and clean_text."""
    common.bound_batches(docs.sparkSession)
    docs = common.without(docs, "n_sentences", "n_removed", "clean_text")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))
    found = _found(docs.select(key.alias("id"), F.col(text).alias("text")), run)
    repeated = found.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "first")
    gone = found.join(repeated, "h").where("id > first").groupBy("id").agg(F.collect_set("place").alias("places")).withColumnRenamed("id", "__id")

    @F.arrow_udf("n int, gone int, clean string")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = list(zip(*without_spans(texts.to_pylist(), places.to_pylist(), run), strict=True))
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out or [()] * 3, (pa.int32(), pa.int32(), pa.string()), strict=True)], names=["n", "gone", "clean"])

    joined = docs.withColumn("__key", key).join(gone, F.col("__key") == F.col("__id"), "left")
    cleaned = joined.withColumn("__c", cut(F.col(text), F.col("places")))
    return cleaned.select(*[f"`{c}`" for c in docs.columns], F.col("__c.n").alias("n_sentences"), F.col("__c.gone").alias("n_removed"), F.col("__c.clean").alias("clean_text"))


def without_spans(texts: list[str | None], places: list[list[int] | None], run: int = RUN) -> Iterator[tuple[int, int, str | None]]:
    """Of each text (sentences, sentences removed, the rest) after cutting spans that start at these places and what it repeats itself.

    A sentence reaches to the next one's first word; the first begins with the text.
    """
    for lo, hi, owner, place, number, at, h in parsed(texts, run):
        again = at[~_first(owner[at], h)]
        bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
        cover = np.zeros(len(owner) + run + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + run, -1)
        for k in range(lo, hi):
            start, n = int(bounds[k - lo]), int(bounds[k - lo + 1] - bounds[k - lo])
            for p in places[k] or ():
                if p + run <= n:
                    cover[start + p] += 1
                    cover[start + p + run] -= 1
        gone = np.cumsum(cover)[: len(owner)] > 0
        for k in range(lo, hi):
            a, b = int(bounds[k - lo]), int(bounds[k - lo + 1])
            if not gone[a:b].any():
                yield b - a, 0, texts[k]
                continue
            begins = [0, *place[a + 1 : b].tolist()]
            ends = [*begins[1:], len(texts[k])]
            yield b - a, int(gone[a:b].sum()), "".join(texts[k][x:y] for x, y, g in zip(begins, ends, gone[a:b].tolist(), strict=True) if not g)
