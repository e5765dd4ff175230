"""Files read by pieces, from tasks: what a reader asks for is fetched, and nothing else."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

#: What is fetched at once. A view of more than BLOCK bytes stays a view.
BLOCK = 1 << 16


class Bytes:
    """A part of an open file that is sliced and searched like bytes; blocks are fetched when they are touched."""

    def __init__(self, file: object, start: int, size: int, blocks: dict[int, bytes]) -> None:
        self.file, self.start, self.size, self.blocks = file, start, size, blocks

    def __len__(self) -> int:
        return self.size

    def _read(self, a: int, b: int) -> bytes:
        out = []
        for k in range(a // BLOCK, (b - 1) // BLOCK + 1 if b > a else 0):
            if k not in self.blocks:
                if len(self.blocks) >= 64:
                    self.blocks.clear()
                self.file.seek(k * BLOCK)
                self.blocks[k] = self.file.read(BLOCK)
            out.append(self.blocks[k][max(a - k * BLOCK, 0) : b - k * BLOCK])
        return b"".join(out)

    def __getitem__(self, at: int | slice) -> int | bytes | Bytes:
        if isinstance(at, slice):
            a, b, _ = at.indices(self.size)
            if b - a > BLOCK:
                return Bytes(self.file, self.start + a, b - a, self.blocks)
            return self._read(self.start + a, self.start + b) if b > a else b""
        if not -self.size <= at < self.size:
            raise IndexError(at)
        return self._read(self.start + at % self.size, self.start + at % self.size + 1)[0]

    def __bytes__(self) -> bytes:
        return self._read(self.start, self.start + self.size)

    def find(self, what: bytes, at: int = 0) -> int:
        while at < self.size:
            found = self._read(self.start + at, self.start + min(at + BLOCK, self.size)).find(what)
            if found >= 0:
                return at + found
            at += BLOCK - len(what) + 1
        return -1

    def replace(self, a: bytes, b: bytes) -> bytes:
        return bytes(self).replace(a, b)

    def decode(self, *how: str) -> str:
        return bytes(self).decode(*how)

    def partition(self, mark: bytes) -> tuple[bytes, bytes, bytes]:
        return bytes(self).partition(mark)

    def split(self, mark: bytes) -> list[bytes]:
        return bytes(self).split(mark)


#: The file system of paths without a scheme and of file: ones.
LOCAL = pa.fs.LocalFileSystem()


@cache
def _remote(base: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(base)


def place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """A file system and a path in it. Only scheme and host are read as parts of a URI: names stand as they are, whatever they hold."""
    m = re.match(r"(?s)([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?(/.*|)$", path)
    if not m or m[1] == "file":
        return LOCAL, m[3] if m else path
    fs, root = _remote(f"{m[1]}://{m[2] or ''}/")
    return fs, root.rstrip("/") + m[3]


def dealt(rows: DataFrame, by: str = "path") -> DataFrame:
    """rows for tasks that do something with a file for each: over all cores, several tasks for each.

    A file costs far more than the bytes of its name, by which Spark would put many thousands into one task.
    """
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), by)


def opened(paths: list[str]) -> Iterator[Bytes | OSError | ValueError]:
    """Each file in turn, or why it cannot be opened."""
    for path in paths:
        try:
            fs, where = place(path)
            file = fs.open_input_file(where)
        except (OSError, ValueError) as error:
            yield error
            continue
        with file:
            yield Bytes(file, 0, file.size(), {})
