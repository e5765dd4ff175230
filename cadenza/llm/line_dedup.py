"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line goes if an earlier one (in the order of doc_id, then of lines in the text) is equal to it, or within
`threshold` edits of it and one edit for each `per_edit` characters of the shorter line: lines of under
per_edit characters are compared for equality alone. Empty lines stay. Steps:

1. Distinct lines, by two 64-bit hashes, with their first place and count. Equal lines are combined
   before the shuffle, so a line that fills a third of the corpus is one row per task.
2. Lengths fall into cells, and a cell's largest length gives the edits e that its lines may have. All lines
   of a cell have e + 1 segments of one size, half of them counted from the line's start and half from its
   end. Hashes of (cell, number, segment) are its index keys, and it probes the segments' places moved by up
   to k characters, k being the number of segments outside of it: if each segment that is met from either
   side had more edits than that, there would be more than e. So each pair within e edits shares a key. A
   line whose length is within the cell before's e of that cell is filed there as well. Three edits take
   nine keys a line or so.
   A semi join by key tells at which keys a line may have a partner, of a length near its own; few lines have one.
3. The texts of these lines are fetched by document and filed at these keys. There a second semi join asks for an earlier
   line within the allowed edits. Before the edit distance, which looks at a band along the diagonal alone, it asks for the
   length, a parity of hashed words, on which an edit changes three bits at most, and counts of LETTERS, which
   an edit changes by two in all.
4. Lines to be removed are gathered per document and cut from its text.

Only keys, hashes, texts of lines that may have a partner and (twice) the documents are shuffled; Spark splits skewed joins. No join makes
pairs: its rows are lines at keys. Different lines that share a segment still meet in the second join until one is found
near, so a template whose lines all differ elsewhere costs the square of their number in comparisons there, and
the texts of such a group are read by one task (which Spark spills).

Cases: null text stays null and has no lines; empty text has one empty line. Rows that agree in doc_id
and text are one document and get the same result. A null doc_id comes before all others. Of equal
doc_ids the order goes by a hash of the text. An empty table gives an empty one. Added columns replace
clashing ones; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tracks import bound_methods
from . import common

THRESHOLD = 3
#: A pair may have one edit for each so many characters of the shorter line, and threshold of them at most.
CHARS_PER_EDIT = 10
#: Frequent letters, twelve at most, by whose counts pairs are told apart early; lines without them lose nothing but time.
LETTERS = "etaoinsrhldu"


def _edits(length: Column, threshold: int, per_edit: int) -> Column:
    """How many edits a line of this length may have."""
    return F.least(F.lit(threshold), F.floor(length / per_edit)).cast("int")


def _widths(threshold: int) -> tuple[int, int, int]:
    """Width of a short cell and of a long one, and the length from which cells are long."""
    narrow = max(5, threshold)
    return narrow, 8 * narrow, 16 * narrow


def _cell(length: Column, threshold: int) -> tuple[Column, Column]:
    """The cell of lengths that a line of this length falls in, by its least length, and the cell before it."""
    narrow, wide, long = _widths(threshold)
    start = F.when(length < long, length - F.pmod(length, F.lit(narrow))).otherwise(length - F.pmod(length, F.lit(wide)))
    return start.cast("int"), F.greatest(start - F.when(start <= long, narrow).otherwise(wide), F.lit(0)).cast("int")


def _places(edits: int) -> list[tuple[int, int]]:
    """The segments of lines with so many edits, with the moves by which each is probed; no move makes an index key."""
    parts = edits + 1
    out = []
    for k in range(parts):
        left = 2 * k < parts
        most = k if left else edits - k
        out += [(k if left else k - parts, m) for m in range(-most, most + 1)]
    return out


def _once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row, where withColumns would copy them into each expression that uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def _keys(lines: DataFrame, threshold: int, per_edit: int) -> DataFrame:
    """lines with length and keys, longs whose last bit is the role: 0 for an index key, 1 for a further one that the line probes; some are null.

    Every key is an expression of its own: code is generated for these, while a function over an array is interpreted.
    """
    narrow, wide, long = _widths(threshold)
    most = lambda cell: _edits(cell + F.when(cell < long, narrow).otherwise(wide) - 1, threshold, per_edit)
    length = F.col("length")

    def key(n: int, cell: Column, edits: Column) -> Column:
        """The n-th key in a cell; a segment counted from the end has a negative number."""
        own = {e: places[n] for e in range(1, threshold + 1) if n < len(places := _places(e))}
        size = F.floor(cell / (edits + 1)).cast("int")
        pick = lambda of: F.coalesce(*[F.when(edits == e, of(k, move)) for e, (k, move) in own.items()])
        at = pick(lambda k, move: (F.lit(0) if k >= 0 else length) + size * k + move)
        hashed = F.xxhash64(cell, pick(lambda k, move: F.lit(k)), F.substring(F.col("line"), at + 1, size))
        role = pick(lambda k, move: F.lit(int(move != 0))).cast("long")
        return F.when((at >= 0) & (at + size <= length), hashed.bitwiseAND(F.lit(-2)).bitwiseOR(role))

    own, before = _cell(length, threshold)
    near = length - F.col("own") < most(F.col("before"))
    rows = _once(lines, {"length": F.char_length("line")}).withColumns({"own": own, "before": before})
    rows = _once(rows, {"edits": most(F.col("own")), "edits_before": F.when(near, most(F.col("before")))})

    def filed(cell: str, edits: str) -> Column:
        keys = F.array(*[key(n, F.col(cell), F.col(edits)) for n in range(len(_places(threshold)))])
        return F.when(F.col(edits) > 0, keys).otherwise(F.array().cast("array<bigint>"))

    return rows.withColumn("keys", F.concat(filed("own", "edits"), filed("before", "edits_before"))).drop("own", "before", "edits", "edits_before")


def _parity(line: Column) -> Column:
    """Of 32 buckets of words, which hold an odd number."""
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(32)).cast("int"))))


def _letters(line: Column) -> Column:
    """How often each of LETTERS occurs, modulo 32, five bits for each."""
    counts = [(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(31)) for c in LETTERS]
    return reduce(Column.bitwiseOR, [F.shiftleft(n, 5 * k) for k, n in enumerate(counts)])


def _letters_apart(a: Column, b: Column) -> Column:
    """By how much the counts differ in all, at least."""

    def one(k: int) -> Column:
        x = F.pmod(F.shiftright(a, 5 * k) - F.shiftright(b, 5 * k), F.lit(32))
        return F.least(x, 32 - x)

    return reduce(Column.__add__, [one(k) for k in range(len(LETTERS))])


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edits between two strings, or most + 1 if there are more (only a band along the diagonal is looked at)."""
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, most + 1).otherwise(found)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once; a lambda's body is otherwise computed anew for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    both = [F.col(doc_id), F.col(text)]
    return docs.withColumns({"__k1": F.xxhash64(*both), "__k2": F.xxhash64(F.lit(1), *both)})


def _lines(keyed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Comparable lines: id, __k1, __k2, no, line, h1, h2."""
    return keyed.select(F.col(doc_id).alias("id"), "__k1", "__k2", F.posexplode(F.split(text, "\n")).alias("no", "line")).where("line <> ''").select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def classes(keyed: DataFrame, doc_id: str, text: str, threshold: int, per_edit: int) -> DataFrame:
    """Distinct lines: h1, h2, place (id, __k1, __k2, no) of the first, n, length, keys."""
    lines = _keys(_lines(keyed, doc_id, text), threshold, per_edit)
    found = lines.select("h1", "h2", F.struct(F.struct("id", "__k1", "__k2", "no").alias("place"), "length", "keys").alias("x"))
    return found.groupBy("h1", "h2").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("n")).select("h1", "h2", "n", "x.*")


def candidates(distinct: DataFrame, threshold: int, per_edit: int) -> DataFrame:
    """Keys (key, h1, role) at which a line may have a partner: another that has the key, one of them as an index key, of a length near its own.

    A semi join stops at the first partner, so there are no more rows than keys, whatever the size of a group.
    """
    # length and role share a long; the sides are alike, and what holds of one is said of both at once, so one shuffle serves them
    each = distinct.select("h1", "length", F.explode("keys").alias("k")).where("k is not null")
    keys = each.select(F.col("k").bitwiseAND(F.lit(-2)).alias("key"), "h1", F.shiftleft(F.col("length").cast("long"), 1).bitwiseOR(F.col("k").bitwiseAND(F.lit(1))).alias("told"))
    role, length = lambda x: F.col(f"{x}.told").bitwiseAND(F.lit(1)), lambda x: F.shiftright(f"{x}.told", 1)
    edits = _edits(F.least(length("a"), length("b")), threshold, per_edit)
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.h1") != F.col("b.h1")) & (role("a") + role("b") < 2) & (F.abs(length("a") - length("b")) <= edits)
    return keys.alias("a").join(keys.alias("b"), met, "left_semi").select("key", "h1", F.col("told").bitwiseAND(F.lit(1)).cast("byte").alias("role"))


def absorbed_lines(keyed: DataFrame, distinct: DataFrame, doc_id: str, text: str, threshold: int, per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(h1, h2) of distinct lines that an earlier line is within the allowed edits of.

    Lines that may have a partner are few; their texts are fetched and go to their keys, where a semi join asks whether there
    is an earlier line near enough. It makes no pairs: of its rows each is a line at one of its keys.
    A first hash alone names a line until then: should two lines share one, both are fetched and asked.
    """
    keys, _ = common.materialize(candidates(distinct, threshold, per_edit), "line-candidates")
    places = distinct.join(keys.select("h1").distinct(), "h1", "left_semi").select("h1", "h2", "place", F.col("place.__k1").alias("p1"), F.col("place.__k2").alias("p2"))
    texts = keyed.select(doc_id, text, "__k1", "__k2").join(places, (F.col("__k1") == F.col("p1")) & (F.col("__k2") == F.col("p2"))).select("h1", "h2", "place", F.get(F.split(text, "\n"), F.col("place.no")).alias("line")).dropDuplicates(["h1", "h2"])
    length = F.char_length("line")
    told = texts.withColumns({"length": length, "edits": _edits(length, threshold, per_edit), "parity": _parity(F.col("line")), "letters": _letters(F.col("line"))})
    told, _ = common.materialize(told, "line-texts")
    filed = keys.join(told, "h1")
    both = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    (h1a, h1b), (h2a, h2b), (la, lb), (pa, pb), (qa, qb) = map(both, ("h1", "h2", "length", "parity", "letters"))
    edits = F.least(*both("edits"))
    # what is cheap comes first; places tell lines apart as well as hashes, but with both in use the sides are one shuffle
    near = (F.abs(la - lb) <= edits) & (F.bit_count(pa.bitwiseXOR(pb)) <= 3 * edits) & (_letters_apart(qa, qb) <= 2 * edits)
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.role") + F.col("b.role") < 2) & ((h1a != h1b) | (h2a != h2b))
    earlier = F.col("b.place") < F.col("a.place")
    within = edit_distance(*both("line"), threshold) <= edits
    return filed.alias("a").join(filed.alias("b"), met & near & earlier & within, "left_semi").select("h1", "h2").distinct()


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """docs with n_lines, removed (numbers of lines, from 0) and clean_text."""
    added = ("n_lines", "removed", "clean_text")
    docs = common.without(docs, *added)
    spark, before = docs.sparkSession, set(common.made())
    bound_methods(spark)  # keys and the filters of pairs are long
    keyed = _keyed(docs, doc_id, text)
    distinct, _ = common.materialize(classes(keyed, doc_id, text, threshold, per_edit), "line-classes")
    later = absorbed_lines(keyed, distinct, doc_id, text, threshold, per_edit).withColumn("absorbed", F.lit(True))
    marked, kept = common.materialize(distinct.select("h1", "h2", "n", "place").join(later, ["h1", "h2"], "left").where("n > 1 or absorbed").select("h1", "h2", F.when(F.col("absorbed").isNull(), F.col("place")).alias("keep")), "line-marks")
    common.remove(spark, *[p for p in common.made() if p not in before and p != kept])
    lines = _lines(keyed, doc_id, text).select("h1", "h2", F.struct("id", "__k1", "__k2", "no").alias("place"))
    gone = lines.join(marked, ["h1", "h2"]).where(F.col("keep").isNull() | (F.col("keep") != F.col("place"))).select(F.col("place.__k1").alias("p1"), F.col("place.__k2").alias("p2"), F.col("place.no").alias("no"))
    per_doc = gone.groupBy("p1", "p2").agg(F.collect_set("no").alias("removed"))
    parts = F.split(text, "\n")
    found = keyed.join(per_doc, (F.col("__k1") == F.col("p1")) & (F.col("__k2") == F.col("p2")), "left")
    kept = let(F.struct(parts.alias("parts"), "removed"), lambda t: F.transform(F.array_except(F.sequence(F.lit(0), F.size(t["parts"]) - 1), t["removed"]), lambda k: F.get(t["parts"], k)))
    clean = F.when(F.col("removed").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return found.select(*[f"`{c}`" for c in docs.columns], F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.array_sort(F.coalesce("removed", F.array().cast("array<int>"))).alias("removed"), clean.alias("clean_text"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """docs with repeated lines cut from their texts."""
    kept, names = common.shield(docs, "n_lines", "removed", "clean_text")
    found = deduplicate(kept, doc_id, text, threshold, per_edit)
    return found.select(*[F.col("clean_text").alias(text) if c == text else F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])
