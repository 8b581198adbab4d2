"""Words and shingles of a batch of texts as arrays of 64-bit hashes, without a loop over words.

A word is hashed by its length and then eight bytes at a time, each step a bijection of those bytes: words of equal
length up to eight bytes never have equal hashes. All words of a batch go through a step together, so they cost
a handful of array operations; words beyond ``LONG_WORD`` bytes are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19
LONG_WORD = 256

_powers: list[np.ndarray] = []
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i <= n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, CHUNK_BYTES >> 3) + 1
        _powers[:] = [_geometric(b, size) for b in (BASE, BASE_INVERSE)]
    return _powers[0], _powers[1]


def _geometric(b: int, size: int) -> np.ndarray:
    x = np.full(size, U(b), U)
    x[0] = U(1)
    return np.cumprod(x, dtype=U)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of an array, by prefix sums: with C[i] the sum of (value + 1) * B**i, a span
    has the hash (C[e] - C[s]) * B**-s in 64-bit arithmetic, whatever its place.

    Only for spans of fewer than 1024 values, or where equal hashes are checked: there are longer ones that have equal
    hashes whatever B is.
    """
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of an array of bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    lengths = ends - starts
    out = mix(lengths.astype(U) * U(BASE) + U(1))
    left = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    while len(left):
        own = eight[starts[left] + at].reshape(-1).view("<u8") & _KEEP[np.minimum(lengths[left] - at, 8)]
        out[left] = mix((out[left] ^ own) * U(0xFF51AFD7ED558CCD) + U(BASE))
        at += 8
        left = left[lengths[left] > at]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of stretches of a string column, each of about ``limit`` bytes."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (one more entry than rows)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(n + 2, bool)
    cut[offsets + 1] = True
    change = inside[1:] & (~inside[:-1] | cut[1:])
    starts = np.flatnonzero(change[:n])
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words before each row."""
    starts, ends, first = word_spans(data, offsets)
    return byte_hashes(_lower[data] if lower else data, starts, ends), first


def chain(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words of an array (rows not heeded)."""
    n = max(len(words) - k + 1, 0)
    out = np.full(n, U(k), U)
    for j in range(k):
        out = mix(out * U(0xFF51AFD7ED558CCD) + words[j : j + n])
    return out


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted distinct k-word shingles; a row of fewer words has its whole sequence as one."""
    whole = chain(words, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        else:
            yield chain(words[a:b], int(b - a)) if b > a else np.zeros(0, U)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
