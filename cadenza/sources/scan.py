"""Ingest: list a tree of files, keep what has not changed, decode the rest.

The tree is listed by tasks (walk.py). What has the same path, size and whole second of change as a row of the
catalogue before is taken from there, and only the others are opened, once: what was read of them is a table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import format_for
from . import store
from .files import LOCAL, dealt, opened, place
from .tags import SCHEMA, TYPES, as_batch, decode
from .walk import SKIP, Tree, excluded, walk

__all__ = ["SKIP", "Scan", "changed", "counters", "excluded", "listing", "read_tags", "run", "scan", "unchanged"]


def listing(spark: SparkSession, roots: list[str], exclude: list[str] = (), include_hidden: bool = False, follow: bool = False) -> DataFrame:
    """path, size, mod_time (whole seconds) of the audio files below the roots; overlapping roots list a file once."""
    return walk(spark, roots, exclude, include_hidden, follow).files


def unchanged(files: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of the catalogue before whose files are as they were."""
    return before.join(files.select("path", "size", "mod_time"), ["path", "size", "mod_time"], "left_semi").select(*before.columns)


def changed(files: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or not as they were."""
    return files.join(before.select("path", "size", "mod_time"), ["path", "size", "mod_time"], "left_anti")


def _gone(path: str) -> bool:
    fs, where = place(path)
    return fs is not LOCAL or not os.path.lexists(where)


def read_file(path: str, kind: str, data: object) -> tuple[dict | None, str | None]:
    """(what a file says of itself, an error): a file that cannot be opened or read through has its format by its ending, one that is gone has nothing."""
    if isinstance(data, FileNotFoundError) and _gone(path):
        return None, str(data)
    if isinstance(data, Exception):
        return {"format": kind}, str(data)
    try:
        return decode(data, kind), None
    except OSError as error:
        return {"format": kind}, str(error)


def read_tags(files: DataFrame) -> DataFrame:
    """files (path, size, mod_time) with what their bytes say of them, in columns of the catalogue, and error.

    The rows that are dealt out are names; a task opens its files and reads their heads, and further pieces
    where the tags say so. Every file has a row; gone tells of one that is no longer there.
    """
    schema_out = f"path string, size long, mod_time long, {SCHEMA}, error string, gone boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = []
            for row, data in zip(rows, opened([r["path"] for r in rows]), strict=True):
                said, error = read_file(row["path"], row["kind"], data)
                found.append({k: row[k] for k in ("path", "size", "mod_time")} | (said or {}) | {"error": error, "gone": said is None})
            yield as_batch(found, [("path", pa.string(), ""), ("size", pa.int64(), 0), ("mod_time", pa.int64(), 0), *TYPES, ("error", pa.string(), None), ("gone", pa.bool_(), False)])

    named = files.select("path", F.col("size").cast("long").alias("size"), F.col("mod_time").cast("long").alias("mod_time"), format_for(F.col("path")).alias("kind"))
    return dealt(named).mapInArrow(run, schema_out)


@dataclass
class Scan:
    """A finished scan: the catalogue, what could not be read, and counts. Its tables stay until close()."""

    tracks: DataFrame
    errors: DataFrame
    tree: Tree
    read: DataFrame
    before: DataFrame | None

    def counters(self) -> DataFrame:
        """One row: dirs, found, parsed, reused, errors, bytes, removed, last_error."""
        dirs, bad = self.tree.directories.agg(F.count(F.lit(1)).alias("dirs")), self.errors.agg(F.count(F.lit(1)).alias("errors"), F.max(F.concat("path", F.lit(": "), "error")).alias("last_error"))
        parsed, now = self.read.agg(F.count(F.lit(1)).alias("parsed")), self.tracks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("now"))
        found = self.tree.files.agg(F.count(F.lit(1)).alias("found"))
        was = F.lit(0).cast("long") if self.before is None else F.lit(self.before.count())
        joined = dirs.join(found, F.lit(True)).join(parsed, F.lit(True)).join(bad, F.lit(True)).join(now, F.lit(True))  # one row each
        return joined.select("dirs", "found", "parsed", (F.col("found") - F.col("parsed")).alias("reused"), "errors", "bytes", F.greatest(was - F.col("now"), F.lit(0)).alias("removed"), "last_error")

    def close(self) -> None:
        self.tree.close()


def run(spark: SparkSession, roots: list[str], before: DataFrame | None = None, exclude: list[str] = (), include_hidden: bool = False, follow: bool = False) -> Scan:
    """Scan the files below the roots. A file whose tags cannot be read is a row with its format by ending.

    before is a stored catalogue, whose rows are taken over for files that are as they were; only others are opened.
    """
    tree = walk(spark, roots, exclude, include_hidden, follow)
    new = tree.files if before is None else changed(tree.files, before)
    path = f"{store.shared_dir(spark)}/read-{uuid.uuid4().hex}"
    made = read_tags(new)
    made.write.parquet(path)
    tree.paths.append(path)
    read = spark.read.schema(made.schema).parquet(path)
    rows = schema.conform(read.where("not gone"))
    rows = rows if before is None else rows.unionByName(schema.conform(unchanged(tree.files, before)))
    return Scan(rows, tree.errors.unionByName(read.where("error is not null").select("path", "error")), tree, read, before)


def scan(spark: SparkSession, roots: list[str], before: DataFrame | None = None, exclude: list[str] = (), include_hidden: bool = False, follow: bool = False) -> DataFrame:
    """The catalogue of the files below the roots; run() tells more of how it went."""
    return run(spark, roots, before, exclude, include_hidden, follow).tracks


def counters(files: DataFrame, before: DataFrame) -> DataFrame:
    """One row: found, reused, parsed, removed (how many fewer files there are than before, if fewer)."""
    marked = files.join(before.select("path", "size", "mod_time", F.lit(1).alias("old")), ["path", "size", "mod_time"], "left")
    now = marked.agg(F.count(F.lit(1)).alias("found"), F.count("old").alias("reused"))
    then = before.agg(F.count(F.lit(1)).alias("was"))
    return now.join(then, F.lit(True)).select("found", "reused", (F.col("found") - F.col("reused")).alias("parsed"), F.greatest(F.col("was") - F.col("found"), F.lit(0)).alias("removed"))
