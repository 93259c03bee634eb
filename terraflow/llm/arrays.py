"""Sorted arrays in shared files, memory-mapped by the tasks that look keys up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from terraflow.llm.common import local_copy, offsets_of, write_file


@dataclass(frozen=True)
class Part:
    """One file: ``size`` sorted 64-bit keys, then as many values of ``dtype``."""

    bucket: int
    path: str
    size: int
    dtype: str = "<u8"


def write_part(folder: str, bucket: int, keys: np.ndarray, values: np.ndarray) -> Part:
    values = np.ascontiguousarray(values)
    path = write_file(folder, f"array-{bucket:06d}", iter((keys.astype("<u8").tobytes(), values.tobytes())))
    return Part(bucket, path, len(keys), values.dtype.str)


class SortedArrays:
    """Parts by bucket; the place of a key is its rank over all parts in bucket order."""

    def __init__(self, parts: Sequence[Part], buckets: int):
        self.buckets, self.parts = buckets, {p.bucket: p for p in parts}
        sizes = np.array([self.parts[b].size if b in self.parts else 0 for b in range(buckets)], np.int64)
        self.base = offsets_of(sizes)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def part(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        if bucket not in self.open:
            p = self.parts[bucket]
            path = local_copy(p.path)
            keys = np.memmap(path, "<u8", "r", 0, (p.size,))
            self.open[bucket] = keys, np.memmap(path, p.dtype, "r", 8 * p.size, (p.size,))
        return self.open[bucket]

    def find(self, keys: np.ndarray, bucket: np.ndarray, missing: float = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1 where a key is missing) and value of each key. Keys sorted by bucket and value are found fastest."""
        rank = np.full(len(keys), -1, np.int64)
        value = np.full(len(keys), missing, np.float64)
        order = np.argsort(bucket, kind="stable") if len(bucket) and (np.diff(bucket) < 0).any() else None
        if order is not None:
            keys, bucket = keys[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.unique(bucket).tolist():
            if b not in self.parts or not self.parts[b].size:
                continue
            lo, hi = int(cuts[b]), int(cuts[b + 1])
            held, values = self.part(b)
            at = np.minimum(np.searchsorted(held, keys[lo:hi]), len(held) - 1)
            ok = held[at] == keys[lo:hi]
            place = np.arange(lo, hi)[ok] if order is None else order[lo:hi][ok]
            rank[place] = self.base[b] + at[ok]
            value[place] = values[at[ok]]
        return rank, value


def range_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash by its upper half; buckets are ranges, in order."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
