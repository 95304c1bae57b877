"""Rows of packed numpy arrays: a shuffle of a few large binary rows in place of many small ones.

A sender cuts its arrays by slice and emits (slice, blob); all blobs of a slice meet in one task. The number of slices follows
the size of the input as the optimizer estimates it, so that a slice fits in a task's memory at any size.
"""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICED = "slice int, blob binary"
#: Bytes of binary rows in one Arrow batch, about.
BATCH = 8_000_000


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head, at, out = np.frombuffer(blob, np.int64, 2 * n, 8), 8 + 16 * n, []
    for code, size in head.reshape(n, 2):
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(blob, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


def batches(rows: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(slice, blob) rows as Arrow batches of bounded size."""
    keys, blobs, size = [], [], 0
    for k, b in rows:
        keys.append(k), blobs.append(b)
        size += len(b)
        if size > BATCH:
            yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])
            keys, blobs, size = [], [], 0
    if keys:
        yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])


def shrink(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as (bytes, values of 255 and more)."""
    return np.minimum(x, 255).astype(np.uint8), x[x >= 255].astype(np.uint64)


def grow(small: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = more.astype(np.int64)
    return out


def slices_for(df: DataFrame, size: int, least: int, text: str = "text") -> int:
    """A slice for every ``size`` bytes that the optimizer expects of df; where it knows nothing, the texts are measured."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected >= 1 << 50:
        expected = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    return max(least, min(1 << 20, expected // size))


def slice_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Slice 0 to n - 1 of a uint64 hash by its upper 32 bits: ranges of the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's ``malloc_trim``, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Give freed memory back to the system: the allocators of C and Arrow keep it else as long as the process lives."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn of a task, after which its memory is released: Spark keeps workers, and the JVM beside them needs the room in later stages."""

    @wraps(fn)
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(it)
        finally:
            release()

    return run


def cut_by(slices: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): rows order[bounds[s]:bounds[s + 1]] belong to slice s, in their old order."""
    order = np.argsort(slices.astype(np.uint16) if n < 65536 else slices, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(slices, minlength=n))])


def gathered(df: DataFrame, n: int, fn: Callable[[int, list[bytes]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to all blobs of each slice."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = defaultdict(list)
        for b in it:
            for k, blob in zip(b.column("slice").to_pylist(), b.column("blob").to_pylist(), strict=True):
                held[k].append(blob)
        for k in sorted(held):
            yield from fn(k, held.pop(k))
            release()

    return df.repartitionById(n, F.col("slice")).mapInArrow(tidy(run), schema)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return first, np.diff(np.concatenate([first, [len(sorted_keys)]]))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total) - np.repeat(ends - size - start, size)
