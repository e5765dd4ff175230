"""FNV-1a identifiers, hashed a batch at a time: numpy takes the n-th byte of all texts of a batch in one step.

Every byte of every path goes through them, and as higher-order functions, which Spark interprets, each byte took a
microsecond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Offset basis and prime (2**40 + 435) of 64-bit FNV-1a.
_BASIS, _PRIME = 0xCBF29CE484222325, 435
_STEP = np.uint64((1 << 40) + _PRIME)


def _hashed(texts: pa.Array, *numbers: pa.Array) -> np.ndarray:
    """Hashes of the texts' bytes, each followed by those of the numbers, the least significant first; of nulls as of nothing."""
    raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else pa.binary())
    n, (_, ends, data) = len(raw), raw.buffers()
    h = np.full(n, _BASIS, np.uint64)
    if n and data is not None:
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(raw.type) else np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64)
        data, sizes = np.frombuffer(data, np.uint8), np.diff(ends)
        order = np.argsort(-sizes, kind="stable")  # the longest first: those with an n-th byte are the first so many
        at, left, mixed = ends[:-1][order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left"), h[order]
        for k, m in enumerate(left.tolist()):
            mixed[:m] = (mixed[:m] ^ data[at[:m] + k]) * _STEP
        h[order] = mixed
    for x in numbers:
        part = np.asarray(x.fill_null(0).cast(pa.int64())).astype("<i8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            h = (h ^ part[:, k]) * _STEP
    return h


def _hex(h: np.ndarray, *given: pa.Array) -> pa.Array:
    """Lower-case hexadecimal without leading zeros; null where any of what was hashed is."""
    known = np.logical_and.reduce([np.asarray(x.is_valid()) for x in given])
    return pa.array([f"{x:x}" for x in h.tolist()], pa.string(), mask=~known)


@F.arrow_udf(StringType())
def _fnv(texts: pa.Array) -> pa.Array:
    return _hex(_hashed(texts), texts)


@F.arrow_udf(StringType())
def _fnv_number(texts: pa.Array, n: pa.Array) -> pa.Array:
    return _hex(_hashed(texts, n), texts, n)


@F.arrow_udf(StringType())
def _fnv_numbers(texts: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    return _hex(_hashed(texts, n, m), texts, n, m)


def fnv(c: Column) -> Column:
    """FNV-1a of a string's or binary's bytes, as hexadecimal text."""
    return _fnv(c)


def half(path: Column | str, k: int) -> Column:
    """Half k (0 or 1) of 128 bits that stand for a path where tables are joined by it; never null."""
    return F.xxhash64(F.lit(k), path)


def track_id(path: Column) -> Column:
    return fnv(path)


def track_version(path: Column, size: Column, mod_time: Column) -> Column:
    """Of a file's path, size and time of change."""
    return _fnv_numbers(path, size.cast("long"), mod_time.cast("long"))


def live_version(base: Column, writes: Column) -> Column:
    """Of a version after this many writes since the scan."""
    return F.coalesce(_fnv_number(base, F.when(writes > 0, writes.cast("long"))), base)


def fnv_text(data: bytes) -> str:
    h = _BASIS
    for b in data:
        h = (h ^ b) * ((1 << 40) + _PRIME) & (1 << 64) - 1
    return f"{h:x}"
