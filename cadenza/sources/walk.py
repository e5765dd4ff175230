"""Directory trees as tables, listed by tasks.

The directories that are still to be read are rows of a table; tasks read them, each going down from its own
until it has seen LIMIT entries, and what directories are left then are the rows of the next round. Nothing of a listing
is on the driver, whatever the size of the tree: it only asks whether a round left any.

Following symbolic links, a round reads one level only, and a directory whose real path any round has read before, or that
several paths reach, is read once (under the first of the paths): loops and diamonds end there.

Names may hold any characters; a name that is not UTF-8 cannot be a row, so it is an error, as is a directory that cannot be read.
"""

from __future__ import annotations

import os
import re
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, basename
from . import store
from .files import LOCAL, place

#: Directories that are never looked into.
SKIP = ("@eaDir", "#recycle", "#snapshot", ".AppleDouble", ".AppleDB", ".Spotlight-V100", ".TemporaryItems", ".Trashes", "$RECYCLE.BIN", "System Volume Information", "lost+found", "node_modules", ".git")
#: Entries that a task sees below one directory before it leaves the rest to the next round.
LIMIT = 4096
#: kind: 'dir' is to be read, 'listed' has been; size, mod_time (seconds) and the rest are of files.
ENTRY = "kind string, path string, size long, mod_time long, real string, error string"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def glob(pattern: str) -> str | None:
    """A shell pattern as a regular expression for whole texts: no part of it matches a slash but in brackets; None if it is malformed."""
    out, at = [], 0
    while at < len(pattern):
        c, at = pattern[at], at + 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            m = re.compile(r"(\^?)((?:(?:\\.|[^\\\]-])(?:-(?:\\.|[^\\\]-]))?)+)\]", re.S).match(pattern, at)
            if not m:
                return None
            one = lambda x: f"\\x{{{ord(x[-1]):x}}}"
            parts = re.findall(r"(\\.|[^\\])(?:-(\\.|[^\\]))?", m[2], re.S)
            out.append(f"[{m[1]}{''.join(one(a) + (f'-{one(b)}' if b else '') for a, b in parts)}]")
            at = m.end()
        elif c == "\\":
            if at == len(pattern):
                return None
            out.append(f"\\x{{{ord(pattern[at]):x}}}")
            at += 1
        else:
            out.append(f"\\x{{{ord(c):x}}}")
    return "".join(out)


def _python(expression: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", expression), re.S)


class Rules:
    """What of a tree is looked at, by names."""

    def __init__(self, exclude: list[str] = (), include_hidden: bool = False) -> None:
        self.exclude, self.hidden = [(p, g and _python(g)) for p in exclude for g in [glob(p)]], include_hidden

    def excluded(self, name: str, path: str) -> bool:
        return any(p in path or (g and (g.fullmatch(name) or g.fullmatch(path))) for p, g in self.exclude)

    def enters(self, name: str, path: str) -> bool:
        return name not in SKIP and (self.hidden or not name.startswith(".")) and not self.excluded(name, path)

    def wants(self, name: str, path: str) -> bool:
        if name.startswith("._") or (name.startswith(".") and not self.hidden):
            return False
        return "." in name and name.rpartition(".")[2].lower() in EXTENSIONS and not self.excluded(name, path)


def excluded(path: Column, patterns: list[str]) -> Column:
    """By a glob on the name or on the path, or as a part of the path."""
    out = F.lit(False)
    for p in patterns:
        if (g := glob(p)) is not None:
            out = out | basename(path).rlike(rf"(?s)\A(?:{g})\z") | path.rlike(rf"(?s)\A(?:{g})\z")
        out = out | path.contains(p)
    return out


def entries(directory: str, follow: bool) -> Iterator[tuple[str, str, bool, int, int, str | None]]:
    """(name, path, whether it is a directory, size, seconds of change, error) of what a directory holds."""
    fs, where = place(directory)
    if fs is not LOCAL:
        for x in fs.get_file_info(pa.fs.FileSelector(where)):
            yield x.base_name, f"{directory.rstrip('/')}/{x.base_name}", x.type == pa.fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 10**9, None
        return
    with os.scandir(where) as found:
        for e in found:
            path = os.path.join(where, e.name)
            try:
                e.name.encode()
            except UnicodeEncodeError:
                yield "", os.fsencode(path).decode("utf-8", "backslashreplace"), False, 0, 0, "the name is not UTF-8"
                continue
            try:
                is_dir = e.is_dir(follow_symlinks=follow)
                of = e.stat(follow_symlinks=False)
                regular = is_dir or stat.S_ISREG(of.st_mode) or stat.S_ISLNK(of.st_mode)
                yield e.name, path, is_dir, of.st_size if regular else 0, int(of.st_mtime // 1), None
            except OSError as error:
                yield e.name, path, False, 0, 0, str(error)


def _read(directory: str, rules: Rules, follow: bool, limit: int) -> Iterator[tuple]:
    """Rows of ENTRY of what is below a directory."""
    queue, seen = [directory], 0
    while queue and seen < limit:
        at, dirs = queue.pop(), []
        try:
            for name, path, is_dir, size, changed, error in entries(at, follow):
                seen += 1
                if error is not None:
                    yield "error", path, None, None, None, error
                elif is_dir:
                    if rules.enters(name, path):
                        dirs.append(path)
                elif size > 0 and rules.wants(name, path):
                    yield "file", path, size, changed, None, None
        except (OSError, ValueError) as error:
            yield "error", at, None, None, None, str(error)
            continue
        yield "listed", at, None, None, _real(at) if follow else None, None
        if follow:
            yield from (("dir", d, None, None, _real(d), None) for d in dirs)
        else:
            queue += dirs
    yield from (("dir", d, None, None, None, None) for d in queue)


def _real(path: str) -> str:
    fs, where = place(path)
    return os.path.realpath(where) if fs is LOCAL else path


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    names = [x.split()[0] for x in ENTRY.split(", ")]
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=names)
            held = []
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True) if held else [()] * 6, _TYPES, strict=True)], names=names)


@dataclass
class Tree:
    """A listing: its entries, and the tables that hold them until close()."""

    entries: DataFrame
    paths: list[str]

    @property
    def files(self) -> DataFrame:
        """path, size, mod_time: each file once, however often roots overlap."""
        return self.entries.where("kind = 'file'").select("path", "size", "mod_time").dropDuplicates(["path"])

    @property
    def errors(self) -> DataFrame:
        return self.entries.where("kind = 'error'").select("path", "error").dropDuplicates(["path"])

    @property
    def directories(self) -> DataFrame:
        return self.entries.where("kind = 'listed'").select("path").dropDuplicates(["path"])

    def close(self) -> None:
        for p in self.paths:
            store.remove(self.entries.sparkSession, p)


def walk(spark: SparkSession, roots: list[str], exclude: list[str] = (), include_hidden: bool = False, follow: bool = False, limit: int = LIMIT) -> Tree:
    """What is below the roots. A root is read whatever its own name is; limit bounds what a task sees below one directory in a round."""
    rules, folder = Rules(exclude, include_hidden), f"{store.shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    width = spark.sparkContext.defaultParallelism

    def listed(frontier: DataFrame, number: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for directory in batch.column(0).to_pylist():
                    yield from _batches(_read(directory, rules, follow, limit))

        frontier.select("path").repartition(width, "path").mapInArrow(run, ENTRY).write.parquet(f"{folder}/{number:04d}")
        return spark.read.schema(ENTRY).parquet(f"{folder}/{number:04d}")

    clean = sorted({r.rstrip("/") or "/" for r in (re.sub("^file:/+", "/", r) for r in roots)})
    frontier, every, rounds = spark.createDataFrame([(r,) for r in clean], "path string"), None, 0
    while True:
        level = listed(frontier, rounds)
        every, rounds = level if every is None else every.unionByName(level), rounds + 1
        new = level.where("kind = 'dir'")
        if follow:
            read = every.where("kind = 'listed'").select("real").distinct()
            frontier = new.join(read, "real", "left_anti").groupBy("real").agg(F.min("path").alias("path"))
        else:
            frontier = new.select("path").distinct()
        if frontier.isEmpty():
            return Tree(every, [folder])
