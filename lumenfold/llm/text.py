"""Vectorised words and rolling hashes over Arrow text columns.

A word is a maximal run of bytes above 0x20 in UTF-8, so ASCII white space and control characters
separate words. ``Sequence`` hashes ranges of words as polynomials modulo the prime 2**61 - 1, which makes the hash of any range one
subtraction and one multiplication. ``Prefix`` does that modulo 2**64 for bytes, where a collision only costs time or is checked.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word from which on it is hashed by itself.
LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Text bytes that are looked at together; a longer text is taken alone.
CHUNK = 1 << 20

_powers = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        made = []
        for b in (BASE, INVERSE):
            p = np.full(n, U(b))
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (in place)."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def loaded(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` bytes (8 at most) of ``data`` from each of ``at`` as an integer, the first byte lowest."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    return words & _MASKS[n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, mixed eight bytes at a time; those of more than LONG bytes are cut from BLAKE2b.

    Unlike a polynomial modulo 2**64 this has no sequences that collide whatever the base.
    """
    length = end - start
    h = mix(loaded(data, start, np.minimum(length, 8)) + length.astype(U) * U(BASE))
    rest = np.flatnonzero((length > 8) & (length <= LONG))
    k = 8
    while len(rest):
        h[rest] = mix((h[rest] ^ loaded(data, start[rest] + k, np.minimum(length[rest] - k, 8))) + U(BASE))
        k += 8
        rest = rest[length[rest] > k]
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Prefix:
    """Hashes of ranges of a sequence of codes."""

    def __init__(self, codes: np.ndarray):
        p, self.inverse = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum(codes * p[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


PRIME = (1 << 61) - 1
_P, _LOW, _MID = U(PRIME), U((1 << 32) - 1), U((1 << 29) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of numbers below PRIME, modulo it."""
    al, ah, bl, bh = a & _LOW, a >> U(32), b & _LOW, b >> U(32)
    low, mid = al * bl, al * bh + ah * bl
    return _reduced((low & _P) + (low >> U(61)) + (mid >> U(29)) + ((mid & _MID) << U(32)) + (ah * bh << U(3)))


_prime_powers = [np.ones(1, U), np.ones(1, U)]
_FACTORS = 0x1B873593CC9E2D51 % PRIME, pow(0x1B873593CC9E2D51 % PRIME, -1, PRIME)


def prime_powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo PRIME, for exponents below n at least."""
    while len(_prime_powers[0]) < n:
        size = len(_prime_powers[0])
        for k, f in enumerate(_FACTORS):
            _prime_powers[k] = np.concatenate((_prime_powers[k], times(_prime_powers[k], np.full(1, pow(f, size, PRIME), U))))
    return _prime_powers


class Sequence:
    """Hashes of ranges of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        power, self.inverse = prime_powers(len(codes) + 1)
        term = times(_reduced(codes), power[: len(codes)])
        # Halves are summed apart, so that no sum overflows.
        low, high = np.cumsum(term & _LOW), np.cumsum(term >> U(32))
        self.sums = np.concatenate((np.zeros(1, U), _reduced(low + (high >> U(29)) + ((high & _MID) << U(32)))))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(times(_reduced(self.sums[end] + (_P - self.sums[start])), self.inverse[start]))


def digests(low: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[bytes]:
    """BLAKE2b of each row's words with a space between; ``first`` has each row's first word and the end."""
    length = end - start
    kept = np.full(int(length.sum()) + len(start), 32, np.uint8)
    kept[np.arange(int(length.sum())) + np.repeat(np.arange(len(start)), length)] = low[ragged(start, length)]
    edge = np.concatenate(([0], np.cumsum(length + 1)))[first]
    raw = memoryview(kept.tobytes())
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a task's memory goes back to the system: a worker process lives on and would keep it beside the executor's own."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


def pieces(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds, cut at rows, and the index of each row's first run (and the end)."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(data > 32, offsets)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... of each range, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return at + np.arange(total)
