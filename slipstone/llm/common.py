"""Helpers that several operators of the subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: fixed values: odd multipliers of the 64-bit hashes (any odd numbers with mixed bits will do)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
#: fixed value: the bytes that part words, [\x20\x09-\x0D]
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def mix64(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX_1
    values = values ^ (values >> np.uint64(27))
    values = values * _MIX_2
    return values ^ (values >> np.uint64(31))


def mixed(value: int) -> int:
    """``mix64`` of a single number, taken modulo 2 ** 64."""
    top = 2**64 - 1
    value &= top
    value ^= value >> 30
    value = value * int(_MIX_1) & top
    value ^= value >> 27
    value = value * int(_MIX_2) & top
    return value ^ (value >> 31)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class WordHasher:
    """64-bit hashes of the words of a text, A-Z lower-cased, by one prefix-sum polynomial.

    Words are maximal runs of bytes other than space and \\x09-\\x0D of the UTF-8 text.
    """

    def __init__(self) -> None:
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        if not len(data):
            return np.zeros(0, dtype=np.uint64)
        if len(data) > len(self.up):
            self._grow(2 * len(data))
        space = np.ones(len(data) + 2, dtype=bool)
        space[1:-1] = _SPACES[data]
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for offset in range(size):
        runs = mix64(runs * _STEP + words[offset : offset + len(runs)])
    return np.unique(runs)


def shared_files(folder: str):
    """(file system, path) of a shared folder for use inside tasks; the folder is made."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    return files, base
