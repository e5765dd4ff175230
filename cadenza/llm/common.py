"""Helpers that the training-data operators share: the shared folder, written tables, Arrow batch bounds."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bounds of the Arrow batches that Python workers get: rows, and bytes (a batch holds one row at least).
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for workers whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a session without that setting (as in tests) gets a local one of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, local, True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> list[str]:
    """Paths that were given out and not removed, oldest first."""
    return list(_made)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: what follows no longer depends on any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if p in _made:
            _made.remove(p)


@cache
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def release() -> None:
    """Give memory that is no longer used back to the system; allocators keep it otherwise, and a Python worker lives on for the stages that follow."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, giving its memory back at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 of an Arrow string column, nulls kept."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs whose total length stays at limit, unless a single text is longer."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names this operator is about to add (an input may bring clashing names)."""
    lowered = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in lowered])


def shield(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with the columns of these names renamed, and their new names by the old, for operators that would replace them."""
    lowered = {n.lower() for n in names}
    renamed = {c: f"__own_{k}" for k, c in enumerate(df.columns) if c.lower() in lowered}
    return df.withColumnsRenamed(renamed), renamed
