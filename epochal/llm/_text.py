"""Whole Arrow batches of texts as numpy arrays: words, lower case and 64-bit hashes without a loop over words.

Hashes are polynomials over random byte values modulo 2**64 (differences of one running sum), then mixed with the length.
They are the same on every machine and in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 2_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply) on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix64(np.arange(1, 257, dtype=U) * U(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(_BASE)), np.full(n, U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = U(1)
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK + 65_536
    while size < n:
        size *= 2
    return _powers(size)


class RangeHash:
    """Hash of any byte range of one chunk. The hash depends on the bytes and the length only."""

    def __init__(self, data: np.ndarray):
        """data: bytes, or uint64 hashes of larger units."""
        n = len(data)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(h + (end - start).astype(U) * U(0xD1B54A32D192ED03))


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: start, end (in data), doc (index), hash."""

    def __init__(self, texts: list[bytes | None], lower: bool = True):
        raw = b"\n".join(t or b"" for t in texts) + b"\n"
        self.data = np.frombuffer(raw, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        space = _SPACE[self.data]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(space & ~before)
        lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1)  # one past each text's separator
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.hash = RangeHash(self.data)(self.start, self.end)
        self.n_docs = len(texts)
        self.per_doc = np.bincount(self.doc, minlength=len(texts)) if len(self.doc) else np.zeros(len(texts), np.int64)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each k-word shingle in text order; a text with 1 to k - 1 words is one shingle."""
    h, n = w.hash, len(w.hash)
    acc = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        acc = mix64(acc * U(0x2545F4914F6CDD1D) + h[j : n - k + 1 + j]) if n >= k else acc
    first = w.doc[: max(0, n - k + 1)]
    whole = first == w.doc[k - 1 :] if n >= k else np.zeros(0, bool)
    doc, out = first[whole], acc[whole]
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < k))
    if len(short):
        begin = np.cumsum(w.per_doc) - w.per_doc
        extra = np.zeros(len(short), U)
        for j in range(k - 1):
            has = w.per_doc[short] > j
            extra[has] = mix64(extra[has] * U(0x2545F4914F6CDD1D) + h[begin[short[has]] + j] + U(j + 1))
        doc, out = np.concatenate([doc, short]), np.concatenate([out, mix64(extra + U(k))])
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, out


def to_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
