"""Words and word hashes inside tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, which is what ``bytes.split()`` yields for UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words whose hashes a worker remembers before it starts afresh.
CACHED_WORDS = 100_000
#: Texts, and bytes of them, that a task holds as Python objects at once; a longer text is alone.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``ROWS_AT_ONCE`` rows and ``BYTES_AT_ONCE`` bytes, or of one row; what a task no longer uses goes back to the system at its end."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, ends[at] + BYTES_AT_ONCE, "right")) - 1
            stop = min(batch.num_rows, at + ROWS_AT_ONCE, max(full, at + 1))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def give_back() -> None:
    """Return free memory of this worker, which idles beside others of its executor, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything once it holds ``CACHED_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingle hashes, sorted; fewer words make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        acc = np.uint64(n)
        for h in hashes:
            acc = mix(np.array([acc]) * np.uint64(_BASE) + h)[0]
        return np.array([acc], np.uint64)
    acc = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        acc = mix(acc + hashes[i : n - k + 1 + i])
    return np.unique(acc)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0][:n], _powers[1][:n]


class Windows:
    """Hashes of any run of words from one pass of prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.down = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words [start, end) for each pair; equal runs have equal hashes wherever they stand."""
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(value + mix((end - start).astype(np.uint64)))
