"""Sorted keys and their counts as small binary values."""

from __future__ import annotations

import numpy as np


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    import zstandard

    rows = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(rows.T.tobytes())


def from_planes(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(rows.T).view(dtype).ravel()


def pack_run(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Differences of sorted 64-bit keys, and the counts."""
    return planes(np.diff(keys.astype(np.uint64), prepend=np.uint64(0))), planes(counts.astype(np.uint64))


def unpack_run(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(from_planes(keys, np.uint64), dtype=np.uint64), from_planes(counts, np.uint64)
