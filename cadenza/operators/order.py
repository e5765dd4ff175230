"""Sorting and paging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import fold

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


@dataclass(frozen=True)
class Page:
    """items is lazy; total counts all rows (an aggregation, run when asked for)."""

    items: DataFrame
    rows: DataFrame
    limit: int
    offset: int

    @property
    def total(self) -> int:
        return self.rows.count()


def clamp(limit: int | None, offset: int | None) -> tuple[int, int]:
    return (DEFAULT_LIMIT if not limit or limit < 0 else min(limit, MAX_LIMIT)), max(offset or 0, 0)


def page(df: DataFrame, keys: list[Column], limit: int | None = None, offset: int | None = None) -> Page:
    """A page of df in the order of keys: Spark keeps limit + offset rows per task and sorts no more."""
    limit, offset = clamp(limit, offset)
    return Page(df.orderBy(*keys).offset(offset).limit(limit), df, limit, offset)


def parse_sort(spec: str | None) -> list[tuple[str, bool]]:
    """'a,-b,+c' as (name, falling)."""
    names = [x.strip() for x in (spec or "").split(",")]
    return [(x.lstrip("+-").strip().lower(), x.startswith("-")) for x in names if x.strip("+- ")]


def _keys(spec: str | None, columns: dict[str, list[Column]], falling_first: tuple[str, ...] = ()) -> list[Column]:
    out = []
    for name, falling in parse_sort(spec):
        for c in columns.get(name, []):
            out.append(c.desc() if falling != (name in falling_first) else c.asc())
    return out


def track_keys(spec: str | None, scored: bool = False) -> list[Column]:
    """Of tracks; unknown names are ignored, and path breaks ties. Without a known name: best score first, then path."""
    c = F.col
    columns = {n: [fold(c(schema.FIELDS[f][0]))] if f not in schema.NUMERIC else [c(schema.FIELDS[f][0])] for n, f in schema._LOOKUP.items()}
    both = [c("disc"), c("track_no")]
    columns |= {"track": both, "trackno": both, "n": both}
    columns |= {n: [c("duration_ms")] for n in ("duration", "time", "length")} | {n: [c("mod_time")] for n in ("modified", "modtime")}
    columns |= {"size": [c("size")], "bitrate": [c("bitrate")], "format": [c("format")]}
    if scored:
        columns |= {"score": [c("score")], "relevance": [c("score")]}
    keys = _keys(spec, columns, ("score", "relevance"))
    return [*(keys or ([c("score").desc()] if scored else [])), c("path")]


def album_keys(spec: str | None) -> list[Column]:
    c = F.col
    columns = {n: [fold(c("album"))] for n in ("album", "name", "title")} | {n: [fold(c("artist"))] for n in ("albumartist", "artist")} | {n: [c("year")] for n in ("year", "date")}
    columns |= {n: [c("tracks")] for n in ("tracks", "count")} | {n: [c("duration_ms")] for n in ("duration", "time", "length")} | {n: [c("with_art")] for n in ("artwork", "withartwork")}
    return [*(_keys(spec, columns) or [fold(c("artist"))]), fold(c("album")), c("id")]


def artist_keys(spec: str | None) -> list[Column]:
    c = F.col
    columns = {n: [fold(c("name"))] for n in ("artist", "albumartist", "name")} | {"albums": [c("albums")]} | {n: [c("tracks")] for n in ("tracks", "count")}
    columns |= {n: [c("duration_ms")] for n in ("duration", "time", "length")} | {n: [c("with_art")] for n in ("artwork", "withartwork")}
    return [*_keys(spec, columns), fold(c("name")), c("id")]
