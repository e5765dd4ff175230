"""The engine's functions for SQL: fold, track_id, track_version, fuzzy_score, osa_distance, search_tracks, and a view to search by."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import fuzzy
from .text import _FROM, _TO, PAIRS, fold_text

_MIX = "(h, b) -> named_struct('hi', (h.hi * 435 + shiftrightunsigned((h.lo ^ b) * 435, 32) + (h.lo ^ b) * 256) & 4294967295L, 'lo', ((h.lo ^ b) * 435) & 4294967295L)"
_TEXT = "h -> regexp_replace(lower(concat(lpad(hex(h.hi), 8, '0'), lpad(hex(h.lo), 8, '0'))), '^0+(?=.)', '')"
_START = f"named_struct('hi', {0xCBF29CE4}L, 'lo', {0x84222325}L)"


def _bytes(x: str) -> str:
    return f"transform(regexp_extract_all(hex(CAST({x} AS BINARY)), '(..)', 1), x -> CAST(conv(x, 16, 10) AS BIGINT))"


def _little_endian(x: str) -> str:
    return f"transform(sequence(0, 7), k -> shiftrightunsigned({x}, 8 * k) & 255L)"


@dataclass
class Searched(AnalyzeResult):
    """What analyze() hands to every task: the query, once it is known to be a literal."""

    query: str = ""
    columns: list[str] = field(default_factory=list)


class SearchTracks:
    """SELECT ... FROM search_tracks(TABLE(tracks), 'artist:~presly year:>1955'): the rows that match, with score.

    The relation may be any that has the columns that the query asks for; all of its columns come back. The query is read once, when the
    statement is analysed, and has to be a constant; a column that it needs and the relation lacks is an error there. Tasks test rows one by one, cheap
    terms first, so on stored tables plans.search, which Catalyst sees through, is the faster way; results are the same.
    """

    def __init__(self, analyzed: Searched) -> None:
        from ..plans.search import parse

        self.terms = sorted(parse(analyzed.query), key=lambda t: t.cost)
        self.have = set(analyzed.columns)
        self.fold = lru_cache(1 << 16)(fold_text)
        self.scores = lru_cache(1 << 16)(lambda text, t: fuzzy.score(text.encode(), t.value.encode(), t.start, t.end))

    @staticmethod
    def analyze(tracks: AnalyzeArgument, query: AnalyzeArgument) -> Searched:
        from .. import schema
        from ..plans.search import parse

        if not tracks.isTable or not query.isConstantExpression or not isinstance(query.value, str):
            raise ValueError("search_tracks takes a table and a query that is a literal")
        columns = [f.name for f in tracks.dataType.fields]
        needed = {schema.FIELDS[f][0] for t in parse(query.value) for f in ([t.field] if t.field else schema.DISPLAY)}
        if lacking := sorted(needed - set(columns)):
            raise ValueError(f"the relation has no {', '.join(lacking)}")
        return Searched(StructType([*tracks.dataType.fields]).add("score", DoubleType()), query=query.value, columns=columns)

    def _texts(self, row: Row, t) -> list[str]:
        from .. import schema

        names = [schema.FIELDS[f][0] for f in ([t.field] if t.field else schema.DISPLAY)]
        return [row[f"{n}_f"] if f"{n}_f" in self.have else self.fold(row[n] or "") for n in names]

    def _score(self, row: Row, t) -> float:
        """Over 0 if a term matches."""
        from .. import schema

        if t.number is not None:
            low, high = t.number
            value = int(row[schema.FIELDS[t.field][0]] or 0)
            return float((low is None or value >= low) and (high is None or value <= high))
        if t.field in schema.NUMERIC:
            return 0.0
        texts = self._texts(row, t)
        if t.fuzzy:
            return max(self.scores(x, t) for x in texts)
        if not t.value:
            return float(any(x == "" for x in texts))
        hit = (lambda x: x == t.value) if t.start and t.end else (lambda x: x.startswith(t.value)) if t.start else (lambda x: x.endswith(t.value)) if t.end else lambda x: t.value in x
        return float(any(map(hit, texts)))

    def eval(self, row: Row, query: str) -> Iterator[tuple]:
        found = []
        for t in self.terms:
            score = self._score(row, t)
            if (score > 0) == t.negate:
                return
            if t.fuzzy and not t.negate:
                found.append(score)
        yield (*row, float(Decimal(repr(sum(found) / len(found))).quantize(Decimal("0.001"), ROUND_HALF_UP)) if found else 1.0)


def register(spark: SparkSession) -> None:
    """All but the fuzzy scores and the search are SQL functions, which Catalyst inlines."""
    fold = f"translate(lower(s), '{_FROM}ς', '{_TO}σ')"
    for letter, two in PAIRS.items():
        fold = f"replace({fold}, '{letter}', '{two}')"
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{make} fold(s STRING) RETURNS STRING RETURN regexp_replace({fold}, '\\\\p{{Mn}}', '')")
    spark.sql(f"{make} track_id(p STRING) RETURNS STRING RETURN aggregate({_bytes('p')}, {_START}, {_MIX}, {_TEXT})")
    spark.sql(f"{make} track_version(p STRING, s BIGINT, m BIGINT) RETURNS STRING RETURN aggregate(concat({_bytes('p')}, {_little_endian('s')}, {_little_endian('m')}), {_START}, {_MIX}, {_TEXT})")
    fuzzy.register(spark)
    spark.udtf.register("search_tracks", F.udtf(SearchTracks))


def search_view(df: DataFrame, query: str, name: str) -> None:
    """A temporary view of the tracks that match, with their scores."""
    from ..plans.search import search_scored

    search_scored(df, query).createOrReplaceTempView(name)
