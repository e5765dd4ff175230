"""License scans by Dice coefficient over word bigrams, in DataFrame operations only.

A text is cut into pieces, at line feeds and after marks of punctuation that white space follows; any run
of consecutive pieces is a unit, so a licence is found on a line of its own, wrapped over several lines, or
between other sentences. Units and templates are normalised to lower-cased words, and the sets of their
word bigrams compared: a Dice coefficient of t needs sizes that differ by a factor f = (2 - t) / t at most.

1. A unit of that score shares n / f of a template's n bigrams. So a text without any of the cue words, which
   are in more than n - n / f bigrams of each template, holds no licence: most texts end here.
2. The same holds for the bigrams of the whole text, which leaves the few templates that it may hold.
3. For those, units with between n / f and n * f bigrams are scored, and the best one counts.
4. Of matches that share a piece only the best stays.

Everything happens within a row: no shuffle, whatever the number of copies of a text. Templates are
literals of the plan and bounded by MAX_TEMPLATES.

Cases: null and empty texts, and texts of under two words, match nothing. Of units that score alike the first
counts, then the shortest; of templates that score alike, the one whose name is first. A template counts once
for each text. Repeated rows get equal results. Long texts are scanned whole. Added columns replace clashing
ones; others pass through.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES
from .line_dedup import let

LEAST, MAX_TEMPLATES = 0.8, 200
_MATCHES = "array<struct<license:string,score:double,first:int,last:int>>"


def plain_words(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def plain_bigrams(text: str) -> list[str]:
    """Bigrams of a template, in the way of bigrams()."""
    words = plain_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pieces(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?:;])[ \t\r\n]+", "$1\n"), "\n")


def bounds(n: int, least: float = LEAST) -> tuple[int, int]:
    """The fewest and the most bigrams of a unit that can match a template of n."""
    factor = (2 - least) / least
    return math.ceil(n / factor - 1e-9), math.floor(n * factor + 1e-9)


def cue_words(prepared: dict[str, list[str]], least: float = LEAST) -> list[str]:
    """Words of which any text with a match holds one; long words, which are rare, are taken first."""
    cues: set[str] = set()
    for grams in prepared.values():
        left = {g for g in grams if not cues & set(g.split(" "))}
        spare = bounds(len(grams), least)[0]  # so many are shared at least
        for w in sorted(Counter(w for g in grams for w in g.split(" ")), key=lambda w: (-len(w), w)):
            if len(left) < spare:
                break
            if w not in cues:
                cues.add(w)
                left = {g for g in left if w not in g.split(" ")}
    return sorted(cues)


def _shared(own: Column, grams: Column) -> Column:
    return F.size(F.array_intersect(own, grams))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """docs with matches: an array of (license, score, first, last), by name; first and last are numbers of pieces."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    prepared = {name: g for name, t in sorted(templates.items()) if (g := plain_bigrams(t))}
    docs = common.without(docs, "matches")
    none = F.array().cast(_MATCHES)
    if not prepared:
        return docs.withColumn("matches", none)
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, g)).alias("grams"), *[F.lit(x).alias(c) for c, x in zip(("lo", "hi"), bounds(len(g), least), strict=True)]) for name, g in prepared.items()])

    every_gram = F.array(*[F.lit(x) for x in sorted({x for g in prepared.values() for x in g})])

    def pairs(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))

    def best(g: Column, t: Column) -> Column:
        """The best unit for a template: (less, first, last), less being the score negated."""

        def score(i: Column, j: Column) -> Column:
            start, n = g["ends"][i] - g["sizes"][i], g["ends"][j] - g["ends"][i] + g["sizes"][i] - 1
            return let(F.array_distinct(F.slice(g["pairs"], start + 1, n)), lambda own: F.struct((_shared(own, t["grams"]) * -2.0 / (F.size(own) + F.size(t["grams"]))).alias("less"), i.alias("first"), j.alias("last")))

        def fits(i: Column, j: Column) -> Column:
            n = g["ends"][j] - g["ends"][i] + g["sizes"][i] - 1
            return (g["sizes"][j] > 0) & (n >= t["lo"]) & (n <= t["hi"])

        every = g["numbers"]
        from_i = lambda i: F.transform(F.filter(F.slice(every, i + 1, F.size(every)), lambda j: fits(i, j)), lambda j: score(i, j))
        return F.array_min(F.flatten(F.transform(F.filter(every, lambda i: g["sizes"][i] > 0), from_i)))

    def matched(flat: Column) -> Column:
        parts = let(F.transform(pieces(F.col(text)), lambda p: F.size(words(p))), lambda sizes: F.struct(sizes.alias("sizes"), F.transform(sizes, lambda _, k: F.aggregate(F.slice(sizes, F.lit(1), k + 1), F.lit(0), lambda a, x: a + x)).alias("ends"), F.transform(sizes, lambda _, k: k).alias("numbers"), pairs(flat).alias("pairs")))
        able = lambda g: let(F.array_intersect(g["pairs"], every_gram), lambda own: F.filter(known, lambda t: _shared(own, t["grams"]) >= t["lo"]))
        hits = let(parts, lambda g: F.transform(able(g), lambda t: F.struct(t["license"].alias("license"), best(g, t).alias("best"))))
        return F.transform(F.filter(hits, lambda m: m["best"]["less"] <= -least), lambda m: F.struct(m["license"].alias("license"), (-m["best"]["less"]).alias("score"), m["best"]["first"].alias("first"), m["best"]["last"].alias("last")))

    def apart(all_: Column) -> Column:
        better = lambda m, o: (o["score"] > m["score"]) | ((o["score"] == m["score"]) & (o["license"] < m["license"]))
        return F.filter(all_, lambda m: ~F.exists(all_, lambda o: better(m, o) & (o["first"] <= m["last"]) & (m["first"] <= o["last"])))

    cues = F.array(*map(F.lit, cue_words(prepared, least)))
    found = let(words(F.col(text)), lambda flat: F.when(F.arrays_overlap(flat, cues), let(matched(flat), apart)).otherwise(none))
    return docs.withColumn("matches", F.coalesce(found, none))
