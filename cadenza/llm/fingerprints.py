"""Document fingerprints: weighted SimHash and permuted block tables, in DataFrame operations only.

Terms are pairs of neighbouring words (lower-cased, split at white space; a text of one word is one
term). A term weighs 1 to 3 by its length, as longer terms are rarer, and each of its occurrences
votes: for a bit that is 1 in the term's 64-bit hash, and against it otherwise. A fingerprint bit is 1
if more than half of the weight is for it.

Block tables: a fingerprint's 64 bits are cut into blocks; two fingerprints within the radius agree on
all but `radius` blocks, so there is one table for each choice of blocks that lead, keyed by their bits;
the join on such keys keeps only pairs within the radius.

Cases: null text is empty; a text without words has fingerprint zero. Texts of any length are hashed
whole. Repeated rows have equal fingerprints. An empty table gives an empty result. Null doc_ids come
after all others in document order; of equal doc_ids the order goes by hashes of the text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RADIUS, BLOCKS = 3, 6
#: Ranges of doc_ids that make up document order: ROWS documents each, MAX_RANGES at most.
ROWS, KNOTS, MAX_RANGES = 1000, 64, 1 << 17
#: Two counters of 32 bits share a long.
_LANES = (1 << 32) + 1


def fingerprinted(df: DataFrame, text: str, keys: list[str], row: Column | None = None) -> DataFrame:
    """For each row of df its keys and fp, the signed 64-bit SimHash of the text.

    row tells rows of equal keys apart, and must be the same when a task runs again. Without it rows are
    numbered as they come, which only the rows of a stored table do in the same order each time.

    Terms are exploded and voted on row by row in generated code; they are added up where they arise,
    so one row of counters for each text and task is shuffled, however long the text is.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), "")
    rows = df.select(*keys, (F.monotonically_increasing_id() if row is None else row).alias("__row"), words.alias("__w"))
    size = F.greatest(F.size("__w") - 1, F.lit(1))
    pairs = F.arrays_zip(F.slice("__w", F.lit(1), size).alias("a"), F.slice("__w", F.lit(2), size).alias("b"))
    terms = rows.select(*keys, "__row", F.explode_outer(pairs).alias("__t"))
    length = F.char_length("__t.a") + F.coalesce(F.char_length("__t.b"), F.lit(0))
    weight = F.when(F.col("__t.a").isNull(), 0).otherwise(1 + (length > 6).cast("int") + (length > 12).cast("int")).cast("long")
    votes = terms.select(*keys, "__row", F.xxhash64("__t.a", "__t.b").alias("__h"), weight.alias("__v"))
    counted = votes.groupBy(*keys, "__row").agg(F.sum("__v").alias("__all"), *[F.sum(F.shiftrightunsigned("__h", k).bitwiseAND(F.lit(_LANES)) * F.col("__v")).alias(f"__l{k}") for k in range(32)])
    fp = F.lit(0).cast("long")
    for b in range(64):
        ones = F.shiftrightunsigned(f"__l{b % 32}", b - b % 32).bitwiseAND(F.lit((1 << 32) - 1))
        fp = fp.bitwiseOR(F.when(ones * 2 > F.col("__all"), F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias("fp"))


def hexed(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def tables(prints: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS, fp: str = "fp") -> DataFrame:
    """One row for each fingerprint and table: prints with `table` and `key`, the bits of the leading blocks."""
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    single = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    leading = [sum(x) for x in combinations(single, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in leading]
    return prints.select("*", F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))


def find_near(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (query, fp, distance) within the radius, for distinct fingerprints `fp` on both sides."""
    asked = tables(queries.select(F.col("fp").alias("query")), blocks, radius, "query")
    filed = tables(index.select("fp"), blocks, radius)
    near = F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius
    return asked.join(filed, (asked["table"] == filed["table"]) & (asked["key"] == filed["key"]) & near).select("query", "fp", F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))).alias("distance")).distinct()


def _ranges(docs: DataFrame, doc_id: str) -> Column:
    """Number of the range of doc_id: KNOTS quantiles over all documents, and even steps between them; null ids have -1."""
    n, knots = docs.agg(F.count(doc_id), F.percentile_approx(doc_id, [k / KNOTS for k in range(KNOTS + 1)], 10000)).first()
    if not n:
        return F.lit(-1)
    knots = sorted(set(knots))
    steps = max(1, min(MAX_RANGES // KNOTS, -(-n // (ROWS * KNOTS))))

    def place(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            a = knots[lo]
            width = max((knots[hi] if hi < len(knots) else a + 1) - a, 1)
            return F.lit(lo * steps) + F.least(F.greatest(F.floor((F.col(doc_id) - a) / F.lit(width) * steps), F.lit(0)), F.lit(steps - 1)).cast("int")
        mid = (lo + hi) // 2
        return F.when(F.col(doc_id) < F.lit(knots[mid]), place(lo, mid)).otherwise(place(mid, hi))

    return F.when(F.col(doc_id).isNull(), -1).otherwise(place(0, len(knots)))


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id") -> DataFrame:
    """docs with `next`, a struct of these columns of the next document in descending doc_id (after the last: the first), and `copy`.

    copy numbers the rows that agree in doc_id and in these columns, from 0. Which of them gets which number
    is all the same, so a task that runs again gives the same rows.

    Documents are ordered within ranges of ids. The first document of each range, which the range
    before it ends with, is fetched by the broadcast of one key for each range (MAX_RANGES at most).
    """
    keyed = docs.withColumns({"__r": _ranges(docs, doc_id), "__o": F.struct(F.col(doc_id).alias("i"), F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))})
    heads = keyed.groupBy("__r").agg(F.max("__o").alias("o"))
    falling = Window.orderBy(F.desc("__r"))  # over ranges, whose number is bounded
    heads = heads.select("__r", F.lead("o").over(falling).alias("o"), F.max(F.struct("__r", "o")).over(Window.partitionBy()).alias("top"), F.lead("__r").over(falling).alias("to"))
    heads = heads.select(F.col("__r").alias("from"), F.coalesce("to", F.col("top.__r")).alias("to"), F.coalesce("o", F.col("top.o")).alias("o"))
    found = keyed.join(F.broadcast(heads), (keyed["__r"] == heads["to"]) & keyed["__o"].eqNullSafe(heads["o"])).select("from", F.struct(*columns).alias("head")).dropDuplicates(["from"])
    order = Window.partitionBy("__r").orderBy(F.desc("__o"))
    led = keyed.withColumns({"__n": F.lead(F.struct(*columns)).over(order), "__copy": F.row_number().over(order) - F.rank().over(order)})
    joined = led.join(found, (led["__r"] == found["from"]) & led["__n"].isNull(), "left")
    return joined.select(*[f"`{c}`" for c in docs.columns], F.coalesce("__n", "head").alias("next"), F.col("__copy").alias("copy"))


def _text_key(text: str) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp: each text, and with its last half taken from the next one's start.

    Texts are shuffled once, to meet the next document's; their fingerprints are a small table by hashes
    of the text, so copies of a text are one row of it. docs is a stored table: its rows come in the same
    order when a task runs again.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    k1, k2 = _text_key("text")
    prints = fingerprinted(own.withColumns({"k1": k1, "k2": k2}), "text", ["k1", "k2"]).groupBy("k1", "k2").agg(F.min("fp").alias("fp"))
    prints, _ = common.materialize(prints, "text-prints")
    half = F.floor(F.char_length("text") / 2).cast("int")
    led = with_next(own, ["text"])
    n1, n2 = _text_key("next.text")
    made = led.select(
        "doc_id", "copy", F.char_length("text").cast("long").alias("n_chars"), k1.alias("k1"), k2.alias("k2"), n1.alias("n1"), n2.alias("n2"),
        F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited_text"),
    ).withColumn("edited_sha256", F.sha2("edited_text", 256))
    made = fingerprinted(made, "edited_text", ["doc_id", "n_chars", "k1", "k2", "n1", "n2", "edited_sha256"], F.col("copy")).withColumnRenamed("fp", "edited_fp")
    after = prints.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("fp").alias("next_fp"))
    return made.join(prints, ["k1", "k2"]).join(after, ["n1", "n2"]).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def near_counts(rows: DataFrame, chosen: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, n_near) for the fingerprints of chosen rows: how many rows lie within the radius, their own included."""
    index, _ = common.materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(chosen).alias("asked")), "prints")
    found = find_near(index.where("asked"), index, radius)
    return found.join(index.select("fp", "n"), "fp").groupBy("query").agg(F.sum("n").alias("n_near")).withColumnRenamed("query", "fp")
