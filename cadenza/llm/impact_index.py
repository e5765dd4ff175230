"""Ranked lexical search over a bit-sliced impact index.

Documents are filed in blocks of at most BLOCK_DOCS rows and BLOCK_BYTES of text (a longer text alone), each block
within one task and in the order of ids. Of every term that a block holds, the index has one row: the places of its
documents, and one bitmap over these for each bit of their impacts. An impact is (10**9 * tf) div (1000 * tf + 8 * m), m = 10 +
(90 * n * N) div L, for n terms in the document, L in all of the N documents that have any; these are counted
first, over all documents. One more row of the block has its ids.

A search weighs its terms by the document frequencies that the index itself sums up: w = floor(1000 * ln((2 N + 2) / (2 df + 1))).
In each block terms' bitmaps, side by side, are multiplied by w by adding shifted copies of them, and added to the sums of
all items that ask for the term, always bit by bit: carries are bitmaps too, kept beside the sums until all terms are in. No
document is scored by itself. The best k are found from the
most significant slice of the sums down: while more than k documents are left those without the bit go, and when
fewer have it they are in and the search goes on among the others; ties are broken by place, that is by id. Blocks'
best are ranked together. What a task holds is bounded by a block and ITEMS items; nothing is broadcast by hand.

Cases: null and empty texts, and texts without terms, have no score and do not count in N. A null id is ranked after
other ids of its score. Rows that share a doc_id are ranked one by one; rows that share an item_id (or null) are one item
with the terms of all. Items whose terms no document holds have no rows. Very long texts are indexed whole. Empty
tables give empty results. Columns other than the id and the text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_DOCS, BLOCK_BYTES = 1 << 13, 32 << 20
#: Items that are searched together, about.
ITEMS = 512
TOP = 10
#: Slices of an impact, which is under 10**6.
BITS = 20
#: Bytes of slices that are multiplied together, about.
TOGETHER = 1 << 18
#: What stands between terms: all of ASCII but digits and letters.
_OTHERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, all their terms)."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = total = 0
        for batch in batches:
            for t in common.as_bytes(batch.column(0)):
                n = len(terms_of(t))
                count, total = count + (n > 0), total + n
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([total], pa.int64())], names=["count", "total"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "count long, total long")
    return tuple(counted.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first())


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    m = 10 + (90 * n * docs) // total
    return (10**9 * tf) // (1000 * tf + 8 * m)


def sliced(values: np.ndarray) -> bytes:
    """BITS bitmaps, the least significant first; a bit for each value."""
    return np.packbits((values >> np.arange(BITS)[:, None]) & 1, axis=1, bitorder="little").tobytes() if len(values) else b""


class _Block:
    """The documents of a block that is being filled."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.ids: list[pa.Scalar] = []
        self.bytes = 0

    def add(self, doc: pa.Scalar, text: bytes | None) -> None:
        known = self.known
        self.terms.append(np.fromiter((known.setdefault(x, len(known)) for x in terms_of(text)), np.int64))
        self.ids.append(doc)
        self.bytes += len(text or b"")

    def rows(self, kind: pa.DataType, number: int, docs: int, total: int) -> Iterator[pa.RecordBatch]:
        ids = pa.array(self.ids, kind)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n = np.array([len(x) for x in self.terms], np.int64)
        keys = np.concatenate(self.terms) * len(order) + np.repeat(place, n)
        keys, tf = np.unique(keys, return_counts=True)
        term, at = np.divmod(keys, len(order))
        value = impacts(tf, n[order][at], docs, total) if len(keys) else keys
        starts = np.searchsorted(term, np.arange(len(self.known) + 1)).tolist()
        at = at.astype("<u2")
        names, kinds = ["block", "term", "n", "at", "slices", "ids"], [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(kind)]
        words = [x.decode() for x in self.known]
        for lo in range(0, len(words), common.BATCH_ROWS):
            part = list(zip(starts[lo : lo + common.BATCH_ROWS], starts[lo + 1 : lo + 1 + common.BATCH_ROWS], strict=False))
            cols = [[number] * len(part), words[lo : lo + len(part)], [b - a for a, b in part], [at[a:b].tobytes() for a, b in part], [sliced(value[a:b]) for a, b in part], [None] * len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip([number, None, None, None, None], kinds, strict=False)), own], names=names)


def build(docs: DataFrame, stats: tuple[int, int], doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The index: block, term, n (documents of the block that hold it), at, slices; and of each block ids, where term is null."""
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("a block has 1 to 65536 documents")
    common.bound_batches(docs.sparkSession)
    kind, (count, total) = docs.schema[doc_id].dataType.simpleString(), stats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, own = TaskContext.get().partitionId() << 32, _Block(), None
        for batch in batches:
            own = batch.schema.field(0).type
            for doc, t in zip(batch.column(0), common.as_bytes(batch.column(1)), strict=True):
                if block.ids and (len(block.ids) == block_docs or block.bytes + len(t or b"") > BLOCK_BYTES):
                    yield from block.rows(own, number, count, total)
                    number, block = number + 1, _Block()
                block.add(doc, t)
        if block.ids:
            yield from block.rows(own, number, count, total)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"block long, term string, n int, at binary, slices binary, ids array<{kind}>")


def spread(at: bytes, slices: bytes, words: int) -> np.ndarray:
    """A term's bitmaps over all places of a block, as (slice, 64 places)."""
    return placed(np.frombuffer(at, "<u2"), np.frombuffer(slices, np.uint8).reshape(BITS, -1), np.zeros((BITS, words * 64), np.uint8))


def placed(places: np.ndarray, slices: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bitmaps over a term's documents as ones over all places of a block; room is zeros, (slice, place), and is left so."""
    room[: len(slices), places] = np.unpackbits(slices, axis=1, count=len(places), bitorder="little")
    out = np.packbits(room, axis=1, bitorder="little").view("<u8")
    room[: len(slices), places] = 0
    return out


def add(sums: np.ndarray, items: np.ndarray, term: np.ndarray, shift: int = 0) -> None:
    """Add a term's bitmaps, shifted, to the sums (item, slice, 64 places) of these items."""
    carry = np.zeros((len(items), term.shape[1]), term.dtype)
    for k, b in enumerate(term, shift):
        a = sums[items, k]
        half = a ^ b
        sums[items, k] = half ^ carry
        carry = (a & b) | (carry & half)
    k = shift + len(term)
    while carry.any():
        a = sums[items, k]
        sums[items, k] = a ^ carry
        carry &= a
        k += 1


def times(term: np.ndarray, w: int | np.ndarray) -> np.ndarray:
    """A term's bitmaps of impacts times w; or those of several terms side by side, with a w for each 64 places."""
    w = np.broadcast_to(np.asarray(w, np.uint64), term.shape[1:])
    bits = int(w.max(initial=0)).bit_length()
    out, own = np.zeros((1, len(term) + bits, term.shape[1]), term.dtype), np.zeros(1, np.int64)
    for k in range(bits):
        chosen = np.negative(w >> np.uint64(k) & np.uint64(1))  # all bits or none
        if chosen.any():
            add(out, own, term & chosen, k)
    return out[0]


def products(slices: list[bytes], weights: list[int], together: int = TOGETHER) -> Iterator[np.ndarray]:
    """Of each term the bitmaps, over its documents, of impacts times its weight."""
    for lo, hi in common.slices(slices, together):
        own = [np.frombuffer(x, np.uint8).reshape(BITS, -1) for x in slices[lo:hi]]
        words = np.array([-(-x.shape[1] // 8) for x in own])
        starts = (8 * np.append(0, np.cumsum(words))).tolist()
        beside = np.zeros((BITS, starts[-1]), np.uint8)
        for x, at in zip(own, starts, strict=False):
            beside[:, at : at + x.shape[1]] = x
        found = times(beside.view("<u8"), np.repeat(np.array(weights[lo:hi], np.uint64), words)).view(np.uint8)
        for x, at, w in zip(own, starts, weights[lo:hi], strict=False):
            yield found[: BITS + w.bit_length(), at : at + x.shape[1]]


def gather(sums: np.ndarray, carries: np.ndarray, term: np.ndarray) -> None:
    """Add bitmaps to an item's (slice, 64 places), all slices at once; what is carried stays in bitmaps of its own, to be added by settle."""
    half = sums ^ carries
    carried = (sums & carries) | (half & term)
    np.bitwise_xor(half, term, out=sums)
    carries[1:] = carried[:-1]
    carries[0] = 0


def settle(sums: np.ndarray, carries: np.ndarray) -> None:
    """Add what was carried to the sums (item, slice, 64 places)."""
    carry = np.zeros_like(sums[:, 0])
    for k in range(sums.shape[1]):
        a, b = sums[:, k].copy(), carries[:, k]
        half = a ^ b
        sums[:, k] = half ^ carry
        carry = (a & b) | (carry & half)


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums) of the k greatest sums over 0, of equal ones the first, from the slices of one item; in no order."""
    within, left = np.zeros_like(sums[0]), np.bitwise_or.reduce(sums, axis=0)
    for s in sums[::-1]:
        more = within | (left & s)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            left &= s
            continue
        within = more
        left &= ~s
        if n == k:
            break
    at = _places(within)
    at = np.append(at, _places(left)[: k - len(at)])
    bit = (sums[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return at, (bit.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0)


def search(index: DataFrame, items: DataFrame, stats: tuple[int, int], item_id: str = "item_id", text: str = "text", k: int = TOP, together: int = ITEMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each item the k best documents with a score over 0. index is a written table."""
    plain = F.translate(text, _UPPER, _UPPER.lower())
    asked = items.select(F.col(item_id).alias("item"), F.explode(F.split(plain, _OTHERS)).alias("term")).where("term <> ''").distinct()
    terms = index.where("term is not null")
    df = terms.select("term", "n").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * stats[0] + 2) / (2 * F.col("df") + 1)))
    named = asked.select(F.col("item").alias("name")).distinct()
    groups = -(-named.count() // together)
    if not groups:
        return _ranked(index, named.select("name", F.lit(0).alias("part"), F.lit(0).alias("slot")), index.where("false").select(F.lit(0).alias("part"), "block", F.array().cast("array<struct<slot:int,at:int,score:long>>").alias("best")), k)
    own = named.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int"))
    own = own.withColumn("slot", (F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1).cast("int"))
    wanted = asked.join(df, "term").withColumn("w", weight).where("w > 0").join(own, F.col("item").eqNullSafe(F.col("name")))
    wanted = wanted.groupBy("part", "term", "w").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    words = -(-block_docs // 64)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        slots, weights = table["slots"].to_pylist(), table["w"].to_pylist()
        bounds = [0] * (max(map(max, slots)) + 1)
        for own, w in zip(slots, weights, strict=True):
            for s in own:
                bounds[s] += w
        depth = (max(bounds) << BITS).bit_length()
        sums, carries = (np.zeros((len(bounds), depth, words), "<u8") for _ in range(2))
        room = np.zeros((depth, words * 64), np.uint8)
        for own, at, slices in zip(slots, table["at"], products(table["slices"].to_pylist(), weights), strict=True):
            term = placed(np.frombuffer(at.as_py(), "<u2"), slices, room)
            for s in own:
                gather(sums[s], carries[s], term)
        settle(sums, carries)
        found = []
        for slot, one in enumerate(sums):
            if bounds[slot]:
                found += [{"slot": slot, "at": a, "score": v} for a, v in zip(*(x.tolist() for x in best(one, k)), strict=True)]
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("at", pa.int32()), ("score", pa.int64())]))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([found], kind)], names=["part", "block", "best"])

    met = terms.select("block", "term", "at", "slices").join(wanted, "term").select("part", "block", "w", "slots", "at", "slices")
    return _ranked(index, own, met.groupBy("part", "block").applyInArrow(run, "part int, block long, best array<struct<slot:int,at:int,score:long>>"), k)


def _ranked(index: DataFrame, own: DataFrame, found: DataFrame, k: int) -> DataFrame:
    ids = index.where("term is null").select("block", "ids")
    rows = found.join(ids, "block").select("part", "ids", F.inline("best")).select("part", "slot", F.get("ids", F.col("at")).alias("doc_id"), "score")
    order = Window.partitionBy("part", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best_rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best_rows.join(own, ["part", "slot"]).select(F.col("name").alias("item_id"), "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = TOP) -> DataFrame:
    """Index all documents, search all items, and keep the result alone."""
    stats = statistics(docs, text)
    index, path = common.materialize(build(docs, stats, doc_id, text), "impacts")
    found, _ = common.materialize(search(index, items, stats, k=k), "ranked")
    common.remove(docs.sparkSession, path)
    return found
