"""Hashed words and n-grams of whole Arrow batches with numpy.

A batch's texts lie in one byte buffer. A running sum of ``table[byte] * BASE**position`` (modulo
2^64) gives the hash of any stretch of bytes by one subtraction and one product with the inverse
power, so words and character n-grams of thousands of texts are hashed without a loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at a time; a single longer text is handled alone.
BLOCK = 1 << 20

#: One fixed random number per byte, the same in every process.
TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: 0 white space, 1 letters, digits and all bytes of non-ASCII characters, 2 other signs.
KIND = np.full(256, 2, dtype=np.uint8)
KIND[SPACE] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the 0 … n - 1, kept up to a few blocks and no longer than was needed so far."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(n, 1).bit_length() if n <= BLOCK else max(n, BLOCK + 1)
        made = np.empty(size, dtype=np.uint64)
        made[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            made[done : done + step] = made[:step] * U(pow(base, done, 1 << 64))
            done += step
        if size > 4 * BLOCK:
            return made
        _powers[base] = known = made
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows of about ``size`` bytes; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        return
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def running(data: np.ndarray) -> np.ndarray:
    """Running hash sums; entry ``i`` covers the bytes before ``i``."""
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(TABLE[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte stretches ``start:end``."""
    return (sums[end] - sums[start]) * powers(UNBASE, len(sums))[start]


def split(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of one non-zero kind, and the number of runs per text."""
    n = len(kind)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets) - 1, dtype=np.int64)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, A-Z lower-cased, and their number per text."""
    low = LOWER[data]
    starts, ends, counts = split((~SPACE[low]).astype(np.uint8), offsets)
    return mix(stretch(running(low), starts, ends)), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words inside a text and their number per text.

    A text of fewer words gives its whole sequence as one; without words it gives none. The
    length enters the hash, so a short sequence never equals a shingle of ``k`` words.
    """
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    made = np.maximum(counts - k + 1, (counts > 0).astype(np.int64))
    total = int(made.sum())
    if not total:
        return np.zeros(0, dtype=np.uint64), made
    within = np.arange(total) - np.repeat(np.cumsum(made) - made, made)
    at = np.repeat(firsts, made) + within
    length = np.repeat(np.minimum(counts, k), made)
    out = length.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    for i in range(k):
        inside = length > i
        step = mix(out * U(0x2545F4914F6CDD1D) + hashes[np.minimum(at + i, len(hashes) - 1)])
        out = np.where(inside, step, out)
    return mix(out), made
