"""Vectorised work on Arrow string buffers, shared by the operators of this subpackage.

Texts are read as the UTF-8 bytes Arrow already holds; words, n-grams and windows are found and hashed for millions of
bytes at a time with numpy, so no Python object is made per row or per word. All hashes are 64 bits, fixed by constants:
a text hashes alike in every run and on every executor.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_tables: dict[int, np.ndarray] = {}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that belong to words: everything above the blank, or only letters, digits and all non-ASCII bytes.
NON_BLANK = np.arange(256) > 32
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def trim() -> None:
    """Gives memory that is free back to the system: Python workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(f: Callable) -> Callable:
    """A mapInArrow function that trims when it ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def tidy_group(f: Callable) -> Callable:
    """The same for a function of groups."""

    def run(key, part):
        try:
            return f(key, part)
        finally:
            trim()

    return run


def tidy_groups(f: Callable) -> Callable:
    """The same for a function that reads a group's batches and yields batches."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(key, batches)
        finally:
            trim()

    return run


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U64((seed * _BASE + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _table(seed: int) -> np.ndarray:
    if seed not in _tables:
        _tables[seed] = mix(np.arange(1, 257, dtype=U64), seed + 101)
    return _tables[seed]


def _power(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2^64."""
    if seed not in _powers or len(_powers[seed][0]) < n:
        base = int(mix(np.array([seed + 7], dtype=U64))[0]) | 1
        inverse = pow(base, -1, 2**64)
        size = max(n, 1 << 16)
        pair = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=U64))
        _powers[seed] = (pair[0], pair[1])
    a, b = _powers[seed]
    return a[:n], b[:n]


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    sizes, raw = column.buffers()[1], column.buffers()[2]
    if len(column) == 0 or sizes is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(sizes, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def chunks(off: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer text is a range of its own and is never cut."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(column: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `size` bytes with their offsets and bytes as of strings(): one range at a time is held lowered or without nulls."""
    off = np.zeros(len(column) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), out=off[1:])
    for i, j in chunks(off, size):
        yield i, j, *strings(column.slice(i, j - i), lower)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes of each range."""
    n = len(data)
    up, down = _power(n + 1, seed)
    total = np.zeros(n + 1, U64)
    np.cumsum(_table(seed)[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start], seed)


class Words:
    """Words of the texts in rows i..j: byte positions and the index of each text's first word."""

    def __init__(self, off: np.ndarray, data: np.ndarray, i: int, j: int, inside: np.ndarray = NON_BLANK):
        self.base = int(off[i])
        self.data = data[off[i] : off[j]]
        self.off = off[i : j + 1] - off[i]
        n = len(self.data)
        hit = inside[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = hit[:-1], hit[1:]
        at = self.off[:-1]
        before[at[at < n]] = False
        at = self.off[1:] - 1
        after[at[at >= 0]] = False
        self.start = np.flatnonzero(hit & ~before)
        self.end = np.flatnonzero(hit & ~after) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)

    def row(self) -> np.ndarray:
        """The row, from 0, of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def stop(self) -> np.ndarray:
        """For each word the index one beyond the last word of its text."""
        return np.repeat(self.first[1:], self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return range_hashes(self.data, self.start, self.end, seed)


def spans(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k successive values: len(h) - k + 1 of them, across text borders too."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    up, down = _power(n + 1, seed + 31)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1], seed + 31)


def sliding(f: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """f over every `width` successive values, by doubling."""
    span = 1
    while span * 2 <= width:
        a = f(a[:-span], a[span:])
        span *= 2
    if span < width:
        a = f(a[: -(width - span)], a[width - span :])
    return a


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value."""
    head, body = [struct.pack("<I", len(arrays))], []
    for a in arrays:
        b = np.ascontiguousarray(a).tobytes()
        head.append(struct.pack("<3sQ", a.dtype.str[1:].encode().ljust(3), len(b)))
        body.append(b)
    return b"".join(head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", blob, 0)
    at, out, pos = 4, [], 4 + 11 * n
    for _ in range(n):
        kind, size = struct.unpack_from("<3sQ", blob, at)
        dtype = np.dtype("<" + kind.decode().strip())
        out.append(np.frombuffer(blob, dtype, size // dtype.itemsize, pos))
        at, pos = at + 11, pos + size
    return out


def unpack_all(blobs) -> list[np.ndarray]:
    """The n-th arrays of many packed values, joined."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts)] if parts else []


def by_group(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indexes in their order) of each key that occurs."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(own)]):
        yield int(own[lo]), order[lo:hi]
