"""SimHash near-dedup by the generalised pigeonhole principle.

1. Fingerprint every text: 64-bit SimHash of 3-word shingles hashed by XXH64 (seed 42).
2. Keep each distinct fingerprint once (copies, however many, are one row from here on).
3. From co-occurrence counts of all bit pairs over all fingerprints, group correlated bits into
   partitions, and give each partition its own threshold by dynamic programming on the estimated
   number of candidates. Thresholds t_i with sum(t_i + 1) = radius + 1 suffice: two fingerprints
   within the radius are within t_i on some partition i.
4. Probe: a fingerprint is filed once per choice of t_i masked bits of partition i; two that are
   within t_i there share a key. Groups of more than CELL fingerprints are cut into blocks, and
   every pair of blocks is a cell of its own, so no task gets a whole large group.
5. Verify by XOR and bit count; a cell emits links that connect its members (a spanning forest where
   there are many), never all pairs.
6. Connected components by alternating large-star and small-star rounds on tables, then every
   document gets the smallest doc_id that it can reach.

deduplicate() finds texts that are alike in their word shingles (NEAR_WORDS words, Jaccard similarity LEAST or
more). Fingerprints cannot serve there: those of all pairs of 0.8 lie too far apart for any radius that can be probed.
So it takes the exact join of jaccard_join with these words and this similarity: no pair is left out, and
a large group of near copies makes about two pairs a text. copies_before() asks the same of texts as they were before parts of them were cut.

Cases: null text and text without words have fingerprint zero, linked like any other. Texts of
under three words are one shingle. Null doc_ids take part but never name a component, unless it has
no other; rows repeated in full share a component. An empty table gives an empty result. Clashing
columns of the input are replaced; others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS, WORDS, SEED, WIDTH = 3, 3, 42, 64
#: Of deduplicate(): words of a shingle, the similarity that makes a link.
NEAR_WORDS, LEAST = 5, 0.8
#: Fingerprints in a block of a large group; a cell holds two blocks at most.
CELL = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: bytes, words: int = WORDS) -> list[bytes]:
    found = text.translate(_LOWER).split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return [b" ".join(x) for x in zip(*(found[k:] for k in range(words)), strict=False)]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    digest = xxhash.xxh64_digest
    hashes = [digest(x, SEED) for x in shingles(text, words)] if text else []
    if not hashes:
        return 0
    votes = np.zeros((8, 256), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.frombuffer(b"".join(hashes[at : at + (1 << 16)]), np.uint8).reshape(-1, 8)[:, ::-1]
        votes += np.bincount((part + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    bits = (votes @ _BYTE_BITS).ravel() * 2 > len(hashes)  # byte 0 is the least significant
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint_bits", words: int = WORDS) -> DataFrame:
    """docs with a signed 64-bit fingerprint of shingles."""
    common.bound_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for t in common.as_bytes(texts)], np.uint64).view(np.int64))

    return common.without(docs, out).withColumn(out, simhash(F.coalesce(F.col(text), F.lit(""))))


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Over all fingerprints: how many there are, and how many have bits i and j set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((WIDTH, WIDTH)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH * WIDTH + 1, dtype=np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    cells = {r.cell: r.n for r in prints.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    flat = np.array([cells.get(k, 0) for k in range(WIDTH * WIDTH + 1)], float)
    return int(flat[-1]), flat[:-1].reshape(WIDTH, WIDTH)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Greedy groups of correlated bits of nearly equal size."""
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    np.fill_diagonal(related, 0)
    left, groups = set(range(WIDTH)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        rest = sorted(left)
        group = [rest[int(related[np.ix_(rest, rest)].sum(axis=1).argmax())]]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(rest[int(related[np.ix_(rest, group)].sum(axis=1).argmax())])
        groups.append(tuple(group))
        left -= set(group)
    return groups


def distance_odds(n: int, both: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """Odds that two fingerprints drawn at random differ in 0, 1, ... of these bits, each bit depending on the one before it."""
    n = max(n, 1)
    p = np.clip(np.diag(both) / n, 0, 1)
    same = p[bits[0]] ** 2 + (1 - p[bits[0]]) ** 2
    odds = np.zeros((2, len(bits) + 1))  # by whether the last bit differs, and the distance
    odds[0, 0], odds[1, 1] = same, 1 - same
    for a, b in zip(bits, bits[1:], strict=False):
        p11 = both[a, b] / n
        p10, p01 = max(p[a] - p11, 0), max(p[b] - p11, 0)
        p00 = max(1 - p11 - p10 - p01, 0)
        joint = np.array([[p00**2 + p01**2 + p10**2 + p11**2, 2 * (p00 * p01 + p10 * p11)], [2 * (p00 * p10 + p01 * p11), 2 * (p00 * p11 + p01 * p10)]])
        given = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-12)
        moved = np.zeros_like(odds)
        for last in (0, 1):
            moved[0] += odds[last] * given[last, 0]
            moved[1, 1:] += odds[last, :-1] * given[last, 1]
        odds = moved
    return odds.sum(axis=0)


def allocate(n: int, both: np.ndarray, radius: int = RADIUS, row_cost: float = 200.0, layouts: tuple[int, ...] = (2, 3, 4, 5, 6)) -> list[Partition]:
    """The partitions and thresholds of least estimated cost; row_cost is that of a filed key against a candidate pair."""
    best: tuple[float, list[Partition]] = (math.inf, [])
    for parts in (p for p in layouts if p <= radius + 1) if radius else (1,):
        groups = group_bits(n, both, parts)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            odds, grown = distance_odds(n, both, bits), {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, radius + 1 - spent):
                    if t > len(bits):
                        break
                    pairs = n * n / 2 * sum(odds[d] * math.comb(len(bits) - d, t - d) for d in range(t + 1))
                    total = cost + (n * math.comb(len(bits), t) * row_cost + pairs if t >= 0 else 0)
                    if spent + t + 1 not in grown or total < grown[spent + t + 1][0]:
                        grown[spent + t + 1] = (total, (*chosen, t))
            table = grown
        cost, chosen = table[radius + 1]
        if cost < best[0]:
            best = cost, [Partition(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
    return best[1]


def masks(plan: list[Partition]) -> list[int]:
    """One signed 64-bit mask for each choice of threshold-many masked bits of each partition."""
    out = []
    for part in plan:
        for hidden in combinations(part.bits, part.threshold):
            m = sum(1 << b for b in part.bits if b not in hidden)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _links_of(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect whatever is connected within the radius among the fingerprints x."""
    if len(x) <= 256:
        a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
        if len(a) <= 2 * len(x):
            return a, b
    heads, tails, free = [], [], np.arange(len(x))
    while len(free) > 1:  # breadth first; what is reached never is compared again
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            at = queue.pop()
            near = np.bitwise_count(x[free] ^ x[at]) <= radius
            if near.any():
                found = free[near]
                free = free[~near]
                heads.append(np.full(len(found), at))
                tails.append(found)
                queue.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (none, none)


def _verify(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(group: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sizes = np.diff(np.append(starts, len(x)))
            size = np.repeat(sizes, sizes)
            heads, tails = [], []
            for gap in range(1, 8):  # groups of up to 8 go together
                ok = (group[gap:] == group[:-gap]) & (size[gap:] <= 8)
                ok[ok] = np.bitwise_count(x[gap:][ok] ^ x[:-gap][ok]) <= radius
                heads.append(x[:-gap][ok])
                tails.append(x[gap:][ok])
            for k in np.flatnonzero(sizes > 8):
                own = slice(starts[k], starts[k] + sizes[k])
                a, b = _links_of(x[own], radius)
                heads.append(x[own][a])
                tails.append(x[own][b])
            a, b = np.concatenate(heads).view(np.int64), np.concatenate(tails).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def parts(rows: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
            return linked(group, np.ascontiguousarray(rows[4]).view(np.uint64))

        held: list[np.ndarray] = []  # the last group, which the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            held.append(cols)
            last, first = cols[:4, -1], held[0][:4, 0]
            if (last == first).all():
                continue
            rows = np.concatenate(held, axis=1)
            same = (rows[:4, 1:] == rows[:4, :-1]).all(axis=0)
            group = np.append(0, np.cumsum(~same))
            cut = int(np.searchsorted(group, group[-1]))
            held = [rows[:, cut:]]
            yield parts(rows[:, :cut], group[:cut])
        if held:
            rows = np.concatenate(held, axis=1)
            yield parts(rows, np.append(0, np.cumsum(~(rows[:4, 1:] == rows[:4, :-1]).all(axis=0))))

    return run


def links(prints: DataFrame, plan: list[Partition], radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (a < b) between fingerprints fp within the radius, enough of them to connect whatever is connected."""
    found = masks(plan)
    filed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in found])).alias("mask", "key"))
    sizes = filed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / cell).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    met = filed.join(sizes, ["mask", "key"]).select("mask", "key", "fp", "n", own.alias("own"))
    cells = met.select("mask", "key", "fp", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return cells.repartition("mask", "key", "i", "j").sortWithinPartitions("mask", "key", "i", "j").mapInArrow(_verify(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) of every node that has a link, root being the least node it can reach; and the tables to remove after use.

    Alternates the large-star and small-star steps until neither changes the links. Each step is an
    aggregation and an equi-join on nodes, which Spark splits where a node has very many links.
    """
    spark = edges.sparkSession

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now, path = common.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    state = mark(now)
    while state[0]:
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, first = common.materialize(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small, second = common.materialize(small, "links")
        common.remove(spark, path, first)
        now, path, before, state = small, second, state, mark(small)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")), [path]


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents' doc_id and fp; of each distinct fingerprint: fp, least doc_id, root, component_id).

    The first is a written table. component_id is the smallest doc_id of all documents that links reach.
    """
    spark = docs.sparkSession
    printed = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", words).select("doc_id", "fp")
    printed, _ = common.materialize(printed, "fingerprints")
    prints, _ = common.materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    n, both = bit_statistics(prints)
    if n < 2:
        return printed, prints.select("fp", "least", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    roots, _ = components(links(prints, allocate(n, both, radius), radius))
    placed = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return printed, placed.join(named, "root").select("fp", "least", "root", "component_id")


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    printed, groups = near_groups(docs, doc_id, text, radius, words)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return printed.join(groups, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def similarity(a: bytes, b: bytes, words: int = NEAR_WORDS) -> float:
    """Jaccard similarity of two texts' sets of shingles; texts without words are alike."""
    x, y = (set(shingles(t, words)) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = NEAR_WORDS, least: float = LEAST) -> DataFrame:
    """One document of each group of texts linked by their shingles, that of the smallest doc_id (of rows that repeat it, one).

    Texts without words are one group. A null doc_id stays only where its group has no other. What goes is joined to the documents by
    two short keys; where little goes, Spark broadcasts it and no text is shuffled.
    """
    from . import jaccard_join  # which takes components() from here

    plain = F.coalesce(F.col(text), F.lit(""))
    own = docs.withColumn("__node", F.xxhash64(plain))
    named = own.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__node").alias("node")).alias("id"), plain.alias("text"))
    found = jaccard_join.classify(named, "id", "text", words, round(100 * least))
    wordless = found.where("n_shingles = 0").agg(F.min("doc_id").alias("__first"))  # one row
    told = found.join(F.broadcast(wordless), F.lit(True)).withColumn("kept", F.col("doc_id") == F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("__first")))
    counted = told.groupBy(F.col("doc_id.node").alias("__gone"), F.col("doc_id.id").alias("__id")).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("__repeats")).where("n > 1 or not __repeats")
    gone, _ = common.materialize(counted.select("__gone", "__id", "__repeats"), "near-gone")
    same = (F.col("__node") == F.col("__gone")) & F.col(doc_id).eqNullSafe(F.col("__id"))
    out = own.join(gone, same, "left_anti")
    if not gone.where("__repeats").isEmpty():
        out = out.unionByName(own.join(gone.where("__repeats"), same, "left_semi").dropDuplicates(["__node", doc_id]))
    return out.select(*[f"`{c}`" for c in docs.columns])


def copies_before(docs: DataFrame, whole: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = NEAR_WORDS, least: float = LEAST) -> DataFrame:
    """doc_ids of docs whose texts, as whole has them, are linked to one of docs with a smaller id: near copies that can no longer be told once lines they share are cut.

    Links are those among all texts of whole that have an id. Only documents with words left in docs count, so that of a group one with words stays, and
    only ids that docs and whole have once, as of others it is not known which text is which. Texts are read in place; ids alone are shuffled.
    """
    from . import jaccard_join

    plain = F.coalesce(F.col(text), F.lit(""))
    docs, whole = (x.where(F.col(doc_id).isNotNull()) for x in (docs, whole))
    named = whole.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(plain).alias("node")).alias("id"), plain.alias("text"))
    found = jaccard_join.classify(named, "id", "text", words, round(100 * least)).where("n_shingles > 0").select(F.col("doc_id.id").alias("__id"), F.col("component_id").alias("__class"))
    worded = F.coalesce(F.col(text).rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    here = docs.select(F.col(doc_id).alias("__id"), F.lit(1).alias("here"), F.lit(0).alias("there"), worded.alias("worded"))
    there = whole.select(F.col(doc_id).alias("__id"), F.lit(0).alias("here"), F.lit(1).alias("there"), F.lit(False).alias("worded"))
    told = here.unionByName(there).groupBy("__id").agg(F.sum("here").alias("here"), F.sum("there").alias("there"), F.max("worded").alias("worded")).where("here = 1 and there = 1 and worded")
    members, _ = common.materialize(found.join(told.select("__id"), "__id"), "near-whole")
    first = members.groupBy("__class").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(first, "__class").where(F.col("__id") > F.col("__first")).select(F.col("__id").alias(doc_id))
