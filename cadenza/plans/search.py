"""The search language: parse a query into terms, compile terms into one filter and one score.

    query  := term*                    all of them must hold; none selects every row
    term   := ['-'] [field ':'] value
    value  := ['~'] ['^'] text ['$']   fuzzy, from the start, to the end
    number := N | >N | >=N | <N | <=N | A-B     for year, track, disc and compilation

Parsing never fails. Text compares by fold(); a table that stores folded columns (name + '_f', see
fold_columns) is searched by those, which lets the scan skip files and row groups by their statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.fuzzy import further_score, fuzzy_score, possible, substring_score
from ..functions.text import fold, fold_text

MAX_INT = (1 << 31) - 1
_TOKEN = re.compile(r'(?:"[^"]*(?:"|\Z)|[^ \t"])+')
_NUMBER = re.compile(r"(?P<op>[<>]=?)?(?P<n>[0-9]+)|(?P<lo>[0-9]+)-(?P<hi>[0-9]+)")


@dataclass(frozen=True)
class Term:
    """field None: any display field. number: bounds (low, high) of a numeric comparison, None for a text term."""

    value: str = ""
    field: str | None = None
    negate: bool = False
    fuzzy: bool = False
    start: bool = False
    end: bool = False
    number: tuple[int | None, int | None] | None = None

    @property
    def cost(self) -> int:
        """Cheap terms go first, as a conjunction stops at the first that fails."""
        return 0 if self.number else 3 if self.fuzzy else 1 if self.start or self.end else 2


def _bounds(text: str) -> tuple[int | None, int | None] | None:
    """Inclusive bounds of a comparison; what is beyond 32 bits matches nothing."""
    text = text.strip()
    if not text:
        return 0, 0
    found = _NUMBER.fullmatch(text)
    if not found:
        return None
    if found["lo"]:
        low, high = int(found["lo"]), int(found["hi"])
        return (1, 0) if max(low, high) > MAX_INT else (low, high)
    n = int(found["n"])
    if n > MAX_INT:
        return 1, 0
    return {None: (n, n), ">": (n + 1, None), ">=": (n, None), "<": (None, n - 1), "<=": (None, n)}[found["op"]]


def _term(token: str) -> Term | None:
    term = Term()
    if token.startswith("-") and len(token) > 1:
        term, token = replace(term, negate=True), token[1:]
    name, colon, rest = token.partition(":")
    if colon and (field := schema.lookup(name)):
        term, token = replace(term, field=field), rest
    marks = {}
    for mark, key in (("~", "fuzzy"), ("^", "start")):
        if token.startswith(mark) and len(token) > 1:
            marks[key], token = True, token[1:]
    if token.endswith("$") and len(token) > 1:
        marks["end"], token = True, token[:-1]
    if term.field in schema.NUMERIC:
        number = _bounds(token)
        return replace(term, number=number, value=fold_text(token))
    term = replace(term, value=fold_text(token), **marks)
    return term if term.value or term.field else None


def parse(query: str) -> list[Term]:
    """Terms of a query; quotes group, and are dropped."""
    tokens = (m[0].replace('"', "") for m in _TOKEN.finditer(query))
    return [t for t in (_term(x) for x in tokens if x) if t]


def fold_columns(df: DataFrame) -> DataFrame:
    """df with a folded copy of every text field, to be stored with it."""
    return df.withColumns({f"{c}_f": fold(F.col(c)) for c in schema.TEXT})


def _folded(df: DataFrame, field: str) -> Column:
    name = schema.FIELDS[field][0]
    return F.col(f"{name}_f") if f"{name}_f" in df.columns else fold(F.col(name))


def _matches(df: DataFrame, t: Term) -> Column:
    if t.number is not None:
        low, high = t.number
        c = schema.column(t.field)
        c = c.cast("int") if t.field == "compilation" else c
        if low == high:
            return c == low
        tests = [c >= low] if low is not None else []
        return reduce(Column.__and__, tests + ([c <= high] if high is not None else []))
    if t.field in schema.NUMERIC:
        return F.lit(False)
    if t.fuzzy:
        return score_of(df, t) > 0
    fields = [t.field] if t.field else schema.DISPLAY

    def one(c: Column) -> Column:
        if not t.value:
            return c == ""
        if t.start and t.end:
            return c == t.value
        return c.startswith(t.value) if t.start else c.endswith(t.value) if t.end else c.contains(t.value)

    return reduce(Column.__or__, [one(_folded(df, f)) for f in fields])


def score_of(df: DataFrame, t: Term) -> Column:
    """The best fuzzy score of a term over its fields."""
    scores = [fuzzy_score(_folded(df, f), t.value, t.start, t.end) for f in ([t.field] if t.field else schema.DISPLAY)]
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def condition(df: DataFrame, terms: list[Term]) -> Column:
    tests = [~_matches(df, t) if t.negate else _matches(df, t) for t in sorted(terms, key=lambda t: t.cost)]
    return reduce(Column.__and__, tests, F.lit(True))


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows that match."""
    terms = parse(query)
    return df.where(condition(df, terms)) if terms else df


def _hits(df: DataFrame, t: Term, fields: list[str]) -> DataFrame:
    """(v, s): distinct folded values of the fields that a fuzzy term finds without a literal hit, and their scores.

    Each value is scored once, whatever the number of tracks and fields that have it, and only if it has the letters for it.
    """
    values = df.select(F.explode(F.array(*[F.col(f"__f_{f}") for f in fields])).alias("v")).distinct().where(possible(F.col("v"), t.value))
    return values.withColumn("s", further_score(F.col("v"), t.value, t.start, t.end)).where("s > 0")


def search_scored(df: DataFrame, query: str) -> DataFrame:
    """Rows that match, with score: the mean over the fuzzy terms that are not negated, else 1, to three places.

    Exact terms filter first. A fuzzy term is then asked of the distinct values of its fields, and what it finds is joined back: by
    a broadcast if Spark finds it small enough, else by value, where Spark splits values that many tracks have. Literal hits need no join.
    """
    terms = parse(query)
    fuzzy = [t for t in terms if t.fuzzy and not t.negate]
    rest = [t for t in terms if t not in fuzzy]
    out = df.where(condition(df, rest)) if rest else df
    if not fuzzy:
        return out.withColumn("score", F.lit(1.0))
    used = sorted({f for t in fuzzy for f in ([t.field] if t.field else schema.DISPLAY)})
    out = out.withColumns({f"__f_{f}": _folded(out, f) for f in used})
    scores = []
    for k, t in enumerate(fuzzy):
        fields, name = [t.field] if t.field else list(schema.DISPLAY), f"__s{k}"
        if not t.value:
            own = [(F.col(f"__f_{f}") == "").cast("double") for f in fields]
        else:
            hits, own = _hits(out, t, fields), []
            for f in fields:
                found = hits.select(F.col("v").alias(f"__v_{f}"), F.col("s").alias(f"{name}_{f}"))
                out = out.join(found, F.col(f"__f_{f}") == F.col(f"__v_{f}"), "left").drop(f"__v_{f}")
                own.append(F.coalesce(f"{name}_{f}", substring_score(F.col(f"__f_{f}"), t.value, t.start, t.end)))
        out = out.withColumn(name, own[0] if len(own) == 1 else F.greatest(*own)).where(F.col(name) > 0)
        scores.append(F.col(name))
    mean = reduce(Column.__add__, scores) / len(scores)
    return out.withColumn("score", F.round(mean, 3)).select(*df.columns, "score")


def is_scored(query: str) -> bool:
    return any(t.fuzzy and not t.negate for t in parse(query))
