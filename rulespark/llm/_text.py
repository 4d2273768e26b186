"""Vectorised work on the UTF-8 bytes of Arrow string batches.

A batch's texts lie one after another in one buffer, so words, hashes and counts are computed over blocks of whole
texts at once. Blocks hold about BLOCK bytes (one text more at most), which bounds memory by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: `[^\x20\x09-\x0D]`.
SOLID = np.ones(256, bool)
SOLID[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def trim() -> None:
    """Gives free memory back to the system: Python workers live on between stages, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if release is not None:
        release(0)


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, bytes, offsets from 0) of whole texts; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
    if offs[-1] - offs[0] > limit:
        trim()


def spans(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross texts, and the first run of each text."""
    if not len(solid):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offs[1:] > offs[:-1]
    first[offs[:-1][full]] = solid[offs[:-1][full]]
    last[offs[1:][full] - 1] = solid[offs[1:][full] - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, offs)


@lru_cache(4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_R, _RINV):
        p = np.ones(1 << bits, U64)
        for k in range(bits):
            p[1 << k : 2 << k] = p[: 1 << k] * U64(pow(base, 1 << k, 1 << 64))
        out.append(p)
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes, for `span_hash`."""
    c = np.zeros(len(data) + 1, U64)
    p = _powers(max(10, int(len(data)).bit_length()))[0][: len(data)]
    np.cumsum((data.astype(U64) + U64(1)) * p, out=c[1:])
    return c


def span_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, wherever they stand."""
    inv = _powers(max(10, int(len(c) - 1).bit_length()))[1]
    return mix((c[e] - c[s]) * inv[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hash(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of each k consecutive items; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, U64)
    for i in range(k):
        out += mix(h[i : i + n] + U64((i + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))
    return mix(out)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def list_array(counts: np.ndarray, values: pa.Array) -> pa.Array:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)


def to_long(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
