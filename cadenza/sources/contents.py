"""What files hold, read by tasks: raw tags and pictures as rows, for tables and as table functions of SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_for
from .files import dealt, opened
from .tags import raw_tags

RAW = "path string, format string, n int, key string, mean string, value string, text string, editable boolean, bytes int, v22 boolean"
PICTURES = "path string, n int, kind int, mime string, data binary, bytes int"
_RAW_TYPES = pa.schema([("path", pa.string()), ("format", pa.string()), ("n", pa.int32()), ("key", pa.string()), ("mean", pa.string()), ("value", pa.string()), ("text", pa.string()), ("editable", pa.bool_()), ("bytes", pa.int32()), ("v22", pa.bool_())])
_PICTURE_TYPES = pa.schema([("path", pa.string()), ("n", pa.int32()), ("kind", pa.int32()), ("mime", pa.string()), ("data", pa.binary()), ("bytes", pa.int32())])
#: Bytes of pictures that go on together.
BATCH = 16 << 20


def _found(paths: list[str], kinds: list[str]) -> Iterator[tuple[str, str, list[dict]]]:
    """(path, format, raw tags) of each file; one that cannot be read has none."""
    for path, kind, data in zip(paths, kinds, opened(paths), strict=True):
        try:
            yield (path, kind, []) if isinstance(data, Exception) else (path, *raw_tags(data, kind))
        except OSError:
            yield path, kind, []


def _raw_rows(paths: list[str], kinds: list[str]) -> pa.RecordBatch:
    rows = [{"mean": "", "v22": False} | r | {"path": p, "format": kind, "n": n} for p, kind, found in _found(paths, kinds) if kind not in ("wav", "aiff") for n, r in enumerate(found)]
    return pa.RecordBatch.from_pylist([{f: r[f] for f in _RAW_TYPES.names} for r in rows], _RAW_TYPES)


def _picture_rows(paths: list[str], kinds: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for p, _, found in _found(paths, kinds):
        for n, (kind, mime, data) in enumerate(r["picture"] for r in found if r.get("picture")):
            held.append({"path": p, "n": n, "kind": kind, "mime": mime, "data": data, "bytes": len(data)})
            size += len(data)
        if size > BATCH:
            yield pa.RecordBatch.from_pylist(held, _PICTURE_TYPES)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, _PICTURE_TYPES)


def _dealt(tracks: DataFrame) -> DataFrame:
    return dealt(tracks.select("path", format_for(F.col("path")).alias("kind")))


def raw(tracks: DataFrame) -> DataFrame:
    """One row for each native key of each track's file, in their order (n): key, namespace, value, whole text, bytes.

    Heads of files are read, not sound. Of formats that have no raw tags here, and of files that cannot be read, there are no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _raw_rows(*(c.to_pylist() for c in batch.columns))

    return _dealt(tracks).mapInArrow(run, RAW)


def pictures(tracks: DataFrame) -> DataFrame:
    """One row for each picture in each track's file, in their order (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _picture_rows(*(c.to_pylist() for c in batch.columns))

    return _dealt(tracks).mapInArrow(run, PICTURES)


def covers(found: DataFrame) -> DataFrame:
    """Of each track's pictures the front cover, else the first."""
    return found.groupBy("path").agg(F.min_by(F.struct("kind", "mime", "data", "bytes"), F.struct((F.col("kind") != 3).alias("other"), "n")).alias("p")).select("path", "p.*")


class RawTags:
    """SELECT * FROM raw_tags(TABLE(SELECT path, kind ...) PARTITION BY path): the same from SQL, for any selection of tracks."""

    def eval(self, row) -> Iterator[tuple]:
        for r in _raw_rows([row["path"]], [row["kind"]]).to_pylist():
            yield tuple(r[f] for f in _RAW_TYPES.names)


class Pictures:
    """SELECT * FROM pictures(TABLE(SELECT path, kind ...) PARTITION BY path)."""

    def eval(self, row) -> Iterator[tuple]:
        for batch in _picture_rows([row["path"]], [row["kind"]]):
            for r in batch.to_pylist():
                yield tuple(r[f] for f in _PICTURE_TYPES.names)


def register(spark: SparkSession) -> None:
    """Make both table functions known to SQL."""
    spark.udtf.register("raw_tags", F.udtf(RawTags, returnType=RAW))
    spark.udtf.register("pictures", F.udtf(Pictures, returnType=PICTURES))
