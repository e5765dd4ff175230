"""Jaccard self-join of documents over word n-grams, by rare-first prefixes.

1. A text's set is its distinct shingles of WORDS words (64-bit hashes); a shorter text is one shingle, a text
   without words has none. Documents of equal sets are one node, named by a hash of the set, from here on.
2. How often shingles occur is counted over all documents in COUNTERS counters, which every task sums up for itself first;
   their logarithms (a byte each, so a table of fixed size) order all shingles, rare ones first, then by hash. Any
   order that all sets share gives right results; a counter that several shingles share only makes prefixes less rare.
3. Prefix filter: sets of n that overlap enough share one of their first n - ceil(t n) + 1 shingles, so only these are joined.
   Keys that one set has alone are dropped; keys of more than CELL rows are cut into blocks, and each pair
   of blocks is a cell of its own.
4. Within a cell pairs pass the length filter, the positional filter (what follows their places must hold enough) and
   the suffix filter (no more shingles can be common than their counts in CLASSES classes of hashes have in common).
5. Of what passes, every node brings its likeliest partner to be verified, by the exact sets; then, among nodes that are not
   connected yet, again; then all pairs that are still left between components. So every link between
   two components has been looked at, a group of near copies makes about two pairs a node, and a pair is verified once.
6. Links are cut into blocks of bounded size, each of which becomes stars around its least nodes; then components on tables
   (see simhash_dedup), and every document gets the least doc_id of its component.

Cases: null text and texts without words are linked with nothing: their component is their own id. Null ids take part but name a component
only if it has no other. Rows repeated in full share a component. Very long texts are read whole. An empty table gives
an empty result. Columns other than the id and the text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash_dedup import components

WORDS, PERCENT = 4, 85
#: Of the frequencies, and in how many parts they are summed.
COUNTERS, CHUNK = 1 << 22, 1 << 12
#: Rows of a block of a large key; a cell holds two blocks at most.
CELL = 2048
CLASSES = 64
#: Bits of the filters that tell which keys are joined and which texts are read again; where one is full, all are.
BITS = 1 << 26
#: Bytes of text that are cut into shingles together; a longer text goes alone. Pairs that are compared together.
PIECE, PAIRS = 4 << 20, 1 << 16
#: Bytes of an Arrow batch, which a worker holds together with all of its shingles.
BATCH = 4 << 20
#: Links that a task turns into stars together.
LINKS = 1 << 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sets_of(texts: list[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text, its distinct shingles' hashes, ascending."""
    for lo, hi in common.slices(texts, PIECE):
        split = [(t or b"").translate(_LOWER).split() for t in texts[lo:hi]]
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(x, len(number)) for x in chain.from_iterable(split)), np.int64)
        value = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))[ids]
        grams = np.zeros(max(len(ids) - words + 1, 0), np.uint64)
        for k in range(words):
            grams = grams * _STEP + value[k : k + len(grams)]
        grams, at = _mix(grams), 0
        for x in split:
            n = len(x)
            if n >= words:
                yield np.unique(grams[at : at + n - words + 1])
            elif n:
                h = np.uint64(n)
                for v in value[at : at + n]:
                    h = (h * _STEP + v) & np.uint64(0xFFFFFFFFFFFFFFFF)
                yield _mix(np.array([h], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n


def node_of(own: np.ndarray) -> int:
    """The name of a set, signed."""
    return int(_mix(np.array([_mix(own).sum(dtype=np.uint64) * _STEP + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of a and of b must share."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n + 1 + (-percent * n // 100)


def tally(docs: DataFrame, words: int) -> DataFrame:
    """Of every document id, node, n and its classes; and of every task its counts: chunk, counts."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own_type = np.zeros(COUNTERS, np.uint32), None
        names = ["id", "node", "n", "classes", "chunk", "at", "counts"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            own_type = batch.schema.field(0).type
            nodes, sizes, classes = [], [], []
            for own in sets_of(common.as_bytes(batch.column(1)), words):
                np.add.at(counts, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
                nodes.append(node_of(own))
                sizes.append(len(own))
                classes.append(np.minimum(np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip([nodes, sizes, classes, *[[None] * len(nodes)] * 3], types, strict=True))], names=names)
        if own_type is not None:
            for lo in range(0, COUNTERS // CHUNK, 64):
                numbers = range(lo, min(lo + 64, COUNTERS // CHUNK))
                packed = [_packed(counts[k * CHUNK : (k + 1) * CHUNK]) for k in numbers]
                none = [None] * len(packed)
                cols = [none, none, none, list(numbers), [at for at, _ in packed], [own for _, own in packed]]
                yield pa.RecordBatch.from_arrays([pa.array(none, own_type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return docs.mapInArrow(common.frugal(run), f"id {kind}, node long, n int, classes binary, chunk int, at binary, counts binary")


def _packed(counts: np.ndarray) -> tuple[bytes | None, bytes]:
    """(places, counts) in as few bytes as they take; places are left out where most counters are used."""
    at = np.flatnonzero(counts)
    width = np.min_scalar_type(int(counts.max()))
    if len(at) * (2 + width.itemsize) < len(counts) * width.itemsize:
        return at.astype("<u2").tobytes(), counts[at].astype(width).tobytes()
    return None, counts.astype(width).tobytes()


def _unpacked(at: bytes | None, counts: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    n = CHUNK if at is None else len(at) // 2
    own = np.frombuffer(counts, {1: "u1", 2: "<u2", 4: "<u4"}[len(counts) // n] if n else "u1")
    return slice(None) if at is None else np.frombuffer(at, "<u2"), own


def levels(tallied: DataFrame) -> np.ndarray:
    """Four times the logarithm of every counter, a byte each; what comes to the driver has COUNTERS bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, own = _unpacked(at, raw)
                sums.setdefault(k, np.zeros(CHUNK, np.uint64))[places] += own
        found = [np.floor(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(found, pa.binary())], names=["chunk", "levels"])

    out = np.zeros(COUNTERS, np.uint8)
    for r in tallied.where("chunk is not null").select("chunk", "at", "counts").repartition("chunk").mapInArrow(common.frugal(run), "chunk int, levels binary").collect():  # bounded by its size
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.levels, np.uint8)
    return out


def prefixes(docs: DataFrame, order: object, words: int, percent: int) -> DataFrame:
    """(key, node, n, pos) of every shingle of a prefix; a node once a task. order is the broadcast levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = order.value, set()
        for batch in batches:
            found: list[tuple[np.ndarray, int, int]] = []
            for own in sets_of(common.as_bytes(batch.column(0)), words):
                n = len(own)
                if not n or 100 * n < percent * (n + 1) or (node := node_of(own)) in seen:
                    continue
                seen.add(node)
                rank = level[(own % np.uint64(COUNTERS)).astype(np.int64)]
                found.append((own[np.lexsort((own, rank))[: prefix_size(n, percent)]], node, n))
            if found:
                sizes = np.array([len(x) for x, *_ in found])
                key = np.concatenate([x for x, *_ in found]).view(np.int64)
                pos = np.arange(len(key)) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
                cols = [key, np.repeat(np.array([x for _, x, _ in found]), sizes), np.repeat(np.array([n for *_, n in found], np.int32), sizes), pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "n", "pos"])

    return docs.select("text").mapInArrow(common.frugal(run), "key long, node long, n int, pos int")


def bitmap(places: DataFrame) -> np.ndarray:
    """BITS bits as bytes, set at the hashes of the one column of places: a filter of fixed size, which passes all where it is full."""
    (name,) = places.columns
    p = places.select(_place(name).alias("p"))
    parts = p.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in parts.collect():  # bounded by its size
        own = np.frombuffer(r.bits, np.uint8)
        bits[(r.k - 1) * len(own) : r.k * len(own)] = own
    return bits


def _place(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BITS)) + 1


def told(shared: object, name: str) -> Column:
    """Whether a broadcast bitmap may hold a column's value."""

    @F.arrow_udf("boolean")
    def run(places: pa.Array) -> pa.Array:
        return _held(shared.value, places)

    return run(_place(name))


def _held(bits: np.ndarray, places: pa.Array) -> pa.Array:
    p = places.to_numpy(zero_copy_only=False) - 1
    return pa.array((bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))


def cells(filed: DataFrame, sizes: DataFrame, shared: object, cell: int = CELL) -> DataFrame:
    """Prefixes' rows at keys that more than one has (sizes: key, rows), dealt to cells (key, i, j); shared is the bitmap of these keys."""
    blocks = F.ceil(F.col("rows") / cell).cast("int")
    met = filed.where(told(shared, "key")).join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "pos")


class _Cell:
    """Rows of whole cells in the order of (key, i, j, node), each node of a cell once."""

    def __init__(self, batch: pa.RecordBatch, percent: int) -> None:
        as_long = lambda k: common.column(batch, k).to_numpy(zero_copy_only=False).astype(np.int64)
        key, i, j, self.own, self.node, self.n, self.pos, self.root = map(as_long, ("key", "i", "j", "own", "node", "n", "pos", "root"))
        raw = common.column(batch, "classes").to_pylist()
        self.classes = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, CLASSES)
        self.full = (self.classes == 255).any(axis=1)  # a count of 255 stands for more: two such sets are told apart by the other filters
        self.percent, self.cross = percent, i != j
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        self.starts = np.append(np.flatnonzero(new), len(key))
        self.group = np.cumsum(new)
        self.first = new | np.append(True, self.node[1:] != self.node[:-1])

    def passing(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows that pass all filters, and how alike they seem."""
        na, nb = self.n[a], self.n[b]
        need = least_overlap(na, nb, self.percent)
        ok = (self.root[a] != self.root[b]) & (~self.cross[a] | (self.own[a] != self.own[b]))
        ok &= np.minimum(na, nb) >= need
        ok &= np.minimum(na - self.pos[a], nb - self.pos[b]) >= need
        a, b, need = a[ok], b[ok], need[ok]
        most = np.concatenate([np.zeros(0, np.int64), *(np.minimum(self.classes[a[k : k + PAIRS]], self.classes[b[k : k + PAIRS]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), PAIRS))])
        ok = (most >= need) | (self.full[a] & self.full[b])
        a, b, most = a[ok], b[ok], most[ok]
        return a, b, most / np.maximum(self.n[a] + self.n[b] - most, 1)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at, size = np.flatnonzero(self.first), np.repeat(np.diff(self.starts), np.diff(self.starts))
        small = at[size[at] <= 8]
        for gap in range(1, 8):
            a, b = small[:-gap], small[gap:]
            same = self.group[a] == self.group[b]
            yield self.passing(a[same], b[same])
        for lo, hi in zip(self.starts, self.starts[1:], strict=False):
            if hi - lo > 8:
                own = np.arange(lo, hi)[self.first[lo:hi]]
                step = max(PAIRS // len(own), 1)
                for k in range(0, len(own), step):
                    a, b = np.repeat(own[k : k + step], len(own)), np.tile(own, len(own[k : k + step]))
                    yield self.passing(a[a < b], b[a < b])


def candidates(dealt: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of nodes with different roots that pass the filters: of each node the likeliest one (node, partner), or all (a < b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            cell = _Cell(batch, percent)
            heads, tails, scores = [], [], []
            for a, b, score in cell.pairs():
                if best:
                    a, b, score = cell.node[np.append(a, b)], cell.node[np.append(b, a)], np.append(score, score)
                    order = np.lexsort((b, -score, a))
                    order = order[np.append(True, a[order[1:]] != a[order[:-1]])] if len(order) else order
                    a, b, score = a[order], b[order], score[order]
                else:
                    a, b = np.minimum(cell.node[a], cell.node[b]), np.maximum(cell.node[a], cell.node[b])
                heads.append(a)
                tails.append(b)
                scores.append(score)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (heads, tails, scores)], names=["a", "b", "score"])

        held: list[pa.RecordBatch] = []  # the last cell, which the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            where = lambda x, k: tuple(common.column(x, c)[k].as_py() for c in ("key", "i", "j"))
            held.append(batch)
            if where(batch, batch.num_rows - 1) == where(held[0], 0):
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key, i, j = (common.column(rows, c).to_numpy() for c in ("key", "i", "j"))
            cut = int(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[-1]) + 1
            held = [rows.slice(cut)]
            yield of(rows.slice(0, cut))
        if held:
            yield of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    found = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(common.frugal(run), "a long, b long, score double")
    if best:
        chosen = found.groupBy("a").agg(F.max(F.struct("score", "b")).alias("top"))
        found = chosen.select(F.least("a", "top.b").alias("a"), F.greatest("a", "top.b").alias("b"))
    return found.select("a", "b").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, set) of the wanted nodes (node, least id), read from their texts again."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            nodes, sets = [], []
            for own in sets_of(common.as_bytes(batch.column(1).filter(_held(shared.value, batch.column(0)))), words):
                if len(own) and (node := node_of(own)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(own.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "own"])

    found = docs.select(_place("id"), "text").mapInArrow(common.frugal(run), "node long, own binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    a, b = sets.select(F.col("node").alias("a"), F.col("own").alias("x")), sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", linked("x", "y").alias("linked"))


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Of links (a, b), every node but the least of what they connect, with that one."""
    ends = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in range(2)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    x, y = at[: len(ends[0])], at[len(ends[0]) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low, heads, tails = np.minimum(root[x], root[y]), root[x], root[y]
        np.minimum.at(root, heads, low)
        np.minimum.at(root, tails, low)
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])


def contracted(links: DataFrame, block: int = LINKS) -> DataFrame:
    """Links (a, b) that connect the same nodes in fewer steps: a block of links becomes stars, whose number is less than that of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield _stars(held)
                held = []
        if held:
            yield _stars(held)

    return links.coalesce(max(-(-links.count() // block), 1)).mapInArrow(common.frugal(run), "a long, b long")


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. Links are pairs whose Jaccard similarity is percent hundredths or more."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    before = set(common.made())
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    tallied, _ = common.materialize(tally(docs, words), "tally")
    rows = tallied.where("chunk is null").select("id", "node", F.col("n").cast("long").alias("n_shingles"))
    of_nodes = tallied.where("chunk is null and n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("classes").alias("classes"))
    nodes, _ = common.materialize(of_nodes, "nodes")
    order = spark.sparkContext.broadcast(levels(tallied))
    filed, filed_path = common.materialize(prefixes(docs, order, words, percent), "prefixes")
    order.destroy()
    sizes, sizes_path = common.materialize(filed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "keys")
    repeated = spark.sparkContext.broadcast(bitmap(sizes.select("key")))
    dealt, dealt_path = common.materialize(cells(filed, sizes, repeated, cell), "cells")
    repeated.destroy()
    common.remove(spark, filed_path, sizes_path)
    roots = sets = tried = None
    for step in range(3):  # the likeliest partner twice, then whatever is left between components
        known = dealt.join(nodes.select("node", "classes"), "node")
        known = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if roots is not None else known.withColumn("root", F.col("node"))
        pairs = candidates(known, percent, step < 2)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs, _ = common.materialize(pairs, "pairs")
        if roots is not None and pairs.isEmpty():
            continue
        if sets is None:
            wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "least")
            sets, _ = common.materialize(_sets(docs, wanted, words), "sets")
            dealt, _ = common.materialize(dealt.join(wanted.select("node"), "node", "left_semi"), "cells")  # no other node has a partner
            common.remove(spark, dealt_path)
        found, _ = common.materialize(verified(pairs, sets, percent), "verified")
        tried = found.select("a", "b") if tried is None else tried.unionByName(found.select("a", "b"))
        own = found.where("linked").select("a", "b")
        links = own if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(own)
        roots, _ = components(contracted(links))
    placed = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "root").select("node", "component_id")
    result = rows.join(classes, "node", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    result, kept = common.materialize(result, "jaccard")
    common.remove(spark, *[p for p in common.made() if p not in before and p != kept])
    return result
