"""Benchmark decontamination with an FM-index per shard of the training texts.

Words are maximal runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. The
test phrases are all windows of WINDOW consecutive words of an item (an item of fewer words, but not
none, is one window). Each shard of documents (an Arrow batch, cut further at SHARD_WORDS words) is
indexed by fm_index.FMIndex over word numbers; a word of no test phrase ends a sequence, as no phrase
can cross it. All phrases are searched backward together, occurrences are located from sampled suffix
positions, and overlapping spans are merged into spans for removal.

The phrases are broadcast in blocks of at most BLOCK_BYTES of item text, each block searched in all
documents in turn, so no broadcast grows with the benchmark. No shuffle moves the documents.

Cases: null or empty texts and items have no words; repeated items are all reported; a document that
repeats gets the same result; items with a null id contaminate and are reported as an empty id. Very
long documents are indexed in several shards whose pieces overlap. An empty benchmark finds nothing.
Clashing columns of the input are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fm_index import FMIndex

WINDOW = 10
#: Words of a shard, and bytes of item texts searched at a time.
SHARD_WORDS, BLOCK_BYTES = 1 << 19, 4 << 20
#: Words of a document that one sequence of the index holds.
PIECE = 118
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_IS_WORD = np.array([b != 32 for b in _FOLD])


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    edge = np.diff(np.concatenate([[False], _IS_WORD[np.frombuffer(text, np.uint8)], [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@dataclass(frozen=True)
class Phrases:
    """numbers: of the words of all phrases, from 1; rows padded with 0; items of phrase k: owner[bounds[k]:bounds[k+1]]."""

    numbers: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray
    owner: np.ndarray
    items: list[str]


def phrases(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> Phrases:
    numbers: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[int]] = {}
    for k, (_, text) in enumerate(items):
        own = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words(text))
        for at in range(max(1, len(own) - window + 1) if own else 0):
            of = found.setdefault(own[at : at + window], [])
            if not of or of[-1] != k:
                of.append(k)
    rows = np.zeros((len(found), window), np.int32)
    for k, p in enumerate(found):
        rows[k, : len(p)] = p
    return Phrases(numbers, rows, (rows > 0).sum(axis=1), np.append(0, np.cumsum([len(x) for x in found.values()])).astype(np.int64), np.array([x for of in found.values() for x in of], np.int64), [i for i, _ in items])


def _occurrences(seq: np.ndarray, what: Phrases, piece: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence in the words of a shard (0: no phrase's word, or between documents)."""
    count = -(-len(seq) // piece)
    padded = np.zeros(count * piece + window - 1, np.int32)
    padded[: len(seq)] = seq
    pieces = np.zeros((count, piece + window), np.int32)  # each also holds the next one's first words, then a 0
    pieces[:, :-1] = np.lib.stride_tricks.sliding_window_view(padded, piece + window - 1)[::piece]
    index = FMIndex(pieces.ravel(), int(what.rows.max(initial=1)), piece + window)
    lo, hi = index.search(what.rows, what.lengths)
    hit = np.flatnonzero(hi > lo)
    sizes = (hi - lo)[hit]
    rows = np.repeat(lo[hit] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    which, offset = np.divmod(index.locate(rows), piece + window)
    return np.repeat(hit, sizes), which * piece + offset


def _shards(texts: list[bytes | None], what: Phrases, limit: int, window: int) -> Iterator[tuple[list[int], list[int], list[int], np.ndarray]]:
    """Documents' numbers, their first words in the document, their starts in the shard, and the shard's word numbers.

    A document beyond the limit goes in parts that overlap by window - 1 words.
    """
    docs, firsts, starts, parts, total = [], [], [], [], 0
    for k, text in enumerate(texts):
        own = words(text)
        if not own:
            continue
        ids = np.fromiter(map(what.numbers.get, own, (0,) * len(own)), np.int32, len(own))
        for at in range(0, max(1, len(ids) - window + 1), limit):
            part = ids[at : at + limit + window - 1]
            if total and total + len(part) > limit:
                yield docs, firsts, starts, np.concatenate(parts)
                docs, firsts, starts, parts, total = [], [], [], [], 0
            docs.append(k)
            firsts.append(at)
            starts.append(total)
            parts += [part, np.zeros(1, np.int32)]
            total += len(part) + 1
    if parts:
        yield docs, firsts, starts, np.concatenate(parts)


def hits(texts: list[bytes | None], what: Phrases, window: int = WINDOW, limit: int = SHARD_WORDS) -> list[tuple[list[int], list[int]]]:
    """Of each text: merged spans of hit words, flat (start, end, start, end, ...), and numbers of the items found."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    if len(what.rows):
        for docs, firsts, starts, seq in _shards(texts, what, limit, window):
            phrase, at = _occurrences(seq, what, PIECE, window)
            if not len(phrase):
                continue
            cover = np.zeros(len(seq) + 1, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + what.lengths[phrase], -1)
            edge = np.diff(np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]]).astype(np.int8))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                k = int(np.searchsorted(starts, a, "right")) - 1
                spans[docs[k]].append((a - starts[k] + firsts[k], b - starts[k] + firsts[k]))
            where = np.searchsorted(starts, at, "right") - 1
            for k, p in np.unique(np.stack([where, phrase]), axis=1).T.tolist():
                items[docs[k]].update(what.owner[what.bounds[p] : what.bounds[p + 1]].tolist())
    return [([x for s in merge(a) for x in s], sorted(b)) for a, b in zip(spans, items, strict=True)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of these spans (flat word numbers) and what stands between them."""
    starts, ends = word_spans(text)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The items in blocks of at most limit bytes of text (a longer item is a block of its own)."""
    held, total = [], 0
    for r in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("binary").alias("t")).toLocalIterator():
        n = len(r.t or b"")
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append((r.i, bytes(r.t) if r.t is not None else None))
        total += n
    if held:
        yield held


def _searcher(shared: Broadcast, window: int):
    @F.arrow_udf("spans array<int>, items array<string>")
    def search(texts: pa.Array) -> pa.Array:
        what = shared.value
        found = hits(common.as_bytes(texts), what, window)
        common.release()
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([[what.items[k] for k in b] for _, b in found], pa.list_(pa.string()))], names=["spans", "items"])

    return search


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, spans (flat array of word numbers: start, end, ...), items (ids found) and clean_text (null where nothing is cut)."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    added = ["n_words", "spans", "items", "clean_text"]
    out = common.without(docs, *added)
    keep = [f"`{c}`" for c in out.columns]
    out = out.withColumns({"spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for block in _blocks(benchmark, item_id, item_text, BLOCK_BYTES):
        search = _searcher(spark.sparkContext.broadcast(phrases(block, window)), window)
        out = out.withColumn("__f", search(F.coalesce(F.col(text), F.lit("")))).select(*keep, F.concat("spans", "__f.spans").alias("spans"), F.concat("items", "__f.items").alias("items"))

    @F.arrow_udf("n_words int, spans array<int>, clean string")
    def finish(texts: pa.Array, spans: pa.Array) -> pa.Array:
        counts, merged, clean = [], [], []
        for t, s in zip(common.as_bytes(texts), spans.to_pylist(), strict=True):
            counts.append(len(words(t)))
            merged.append([x for p in merge(list(zip(s[::2], s[1::2], strict=True))) for x in p])
            clean.append(cut(t, merged[-1]).decode() if merged[-1] else None)
        common.release()
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(merged, pa.list_(pa.int32())), pa.array(clean, pa.string())], names=["n_words", "spans", "clean"])

    out = out.withColumn("__g", finish(F.coalesce(F.col(text), F.lit("")), "spans"))
    return out.select(*keep, F.col("__g.n_words").alias("n_words"), F.col("__g.spans").alias("spans"), "items", F.col("__g.clean").alias("clean_text"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the contaminated spans cut out of their texts."""
    kept, names = common.shield(docs, "n_words", "spans", "items", "clean_text")
    found = find(kept, benchmark, text, item_id, item_text, window)
    return found.select(*[F.coalesce("clean_text", text).alias(text) if c == text else F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])
