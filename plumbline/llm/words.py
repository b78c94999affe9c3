"""Words of texts as numbers, for the functions that run inside tasks.

A word is a run of bytes other than space and the control characters 9 to 13, which is what
``bytes.split`` takes apart. Each word stands for 64 bits of its BLAKE2 hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Words remembered in a task; beyond it the memory starts anew.
REMEMBERED = 1 << 19


class WordNumbers(dict):
    """word -> 64 bits, remembered within the task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        number = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the 64 (the finaliser of SplitMix64, fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers, the same in every run."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of a binary column, or of one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, before = 0, 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def run_hashes(numbers: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64 bits of the ``length`` numbers that start at each place, put together from runs of powers of two."""
    n = len(numbers) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, size, run = None, 0, 1, numbers
    for times in odd_numbers(2 * length.bit_length(), seed).reshape(-1, 2):
        if length & size:
            total = run[done:done + n] if total is None else total * times[0] + run[done:done + n]
            done += size
        if done == length:
            break
        run = run[:-size] * times[1] + run[size:]
        size *= 2
    return mixed(total)
