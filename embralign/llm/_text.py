"""Vectorised hashing of words and shingles over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def table_of(separators: list[int]) -> np.ndarray:
    """Byte -> lower-cased byte + 1, or 0 for a separator (bytes from 0x80 are parts of letters)."""
    out = _lower.astype(np.uint16) + 1
    out[separators] = 0
    return out


#: Words are runs without ASCII white space.
SPACED = table_of([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters and digits and of everything outside ASCII.
ALNUM = table_of([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        n = max(n, SLICE + 1)
        for name, base in (("p", BASE), ("i", INVERSE)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (murmur's finaliser)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def text_slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many bytes together, or one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def hash_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, the words of each text, and the byte where each starts."""
    n = len(offsets) - 1
    hashes, starts_all = [], []
    counts = np.zeros(n, np.int64)
    for a, b in text_slices(offsets):
        lo, end = int(offsets[a]), int(offsets[b])
        while lo < end:
            hi = end
            if end - lo > SLICE:  # one very long text: cut at a separator
                hi, step = lo + SLICE, SLICE
                while hi < end:
                    gaps = np.flatnonzero(table[data[hi - step : hi]] == 0)
                    if len(gaps):
                        hi = hi - step + int(gaps[-1]) + 1
                        break
                    hi += step
                hi = min(hi, end)
            code = table[data[lo:hi]]
            word = code != 0
            first = word.copy()
            first[1:] &= ~word[:-1]
            cuts = offsets[a + 1 : b] - lo if hi == end or b == a + 1 else offsets[a + 1 : b] - lo
            cuts = cuts[(cuts > 0) & (cuts < len(code))]
            first[cuts] = word[cuts]
            begins = np.flatnonzero(first)
            last = word.copy()
            last[:-1] &= ~word[1:]
            last[cuts - 1] = word[cuts - 1]
            ends = np.flatnonzero(last) + 1
            p, inv = powers(len(code) + 1)
            total = np.empty(len(code) + 1, U)
            total[0] = 0
            np.multiply(code, p[: len(code)], out=total[1:])
            np.cumsum(total[1:], out=total[1:])
            hashes.append(mix((total[ends] - total[begins]) * inv[begins] + (ends - begins).astype(U)))
            starts_all.append(begins + lo)
            counts[a:b] += np.bincount(np.searchsorted(offsets[a + 1 : b + 1], begins + lo, side="right"), minlength=b - a)[: b - a]
            lo = hi
    if not hashes:
        return np.empty(0, U), counts, np.empty(0, np.int64)
    return np.concatenate(hashes), counts, np.concatenate(starts_all)


_WEIGHTS = mix(np.arange(1, 65, dtype=U) * U(BASE)) | U(1)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text (fewer words: of the whole text), and how many each has."""
    n, per, enough = len(words), np.where(counts >= k, counts - k + 1, np.minimum(counts, 1)), counts >= k
    begin = np.cumsum(counts) - counts
    total = np.zeros(int(per.sum()), U)
    whole = np.repeat(enough, per)
    if enough.any():
        runs = np.full(n - k + 1, k, U)
        for j in range(k):
            runs += words[j : n - k + 1 + j] * _WEIGHTS[j]
        some = per[enough]
        total[whole] = runs[np.arange(int(some.sum())) + np.repeat(begin[enough] - (np.cumsum(some) - some), some)]
    short = np.flatnonzero((per > 0) & ~enough)
    if len(short):
        sums = counts[short].astype(U)
        for j in range(k - 1):
            sums += np.where(j < counts[short], words[np.minimum(begin[short] + j, n - 1)] * _WEIGHTS[j], U(0))
        total[~whole] = sums
    return mix(total), per


def sort_by_group(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of each group in order, groups kept in order."""
    values, a = values.copy(), 0
    for b in np.cumsum(counts).tolist():
        values[a:b].sort()
        a = b
    return values


def distinct_by_group(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group, groups kept in order."""
    values, ends = sort_by_group(values, counts), np.cumsum(counts)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[(ends - counts)[counts > 0]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], before[ends] - before[ends - counts]


def shingle_sets(column: pa.Array, k: int = 5, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes, and their numbers."""
    words, counts, _ = hash_words(*as_bytes(column), table)
    return distinct_by_group(*shingle_hashes(words, counts, k))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or one text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        offsets = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))])
        for a, b in text_slices(offsets, most):
            yield batch.slice(a, b - a)
