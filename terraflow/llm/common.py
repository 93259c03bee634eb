"""Helpers of the training-data operators: Arrow batches, exact ordering, shared files."""

from __future__ import annotations

import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraflow.session import materialize, scratch_path, shared_folder

__all__ = [
    "ascii_lower", "byte_slices", "hash_words", "local_copy", "materialize", "offsets_of", "ordered_table", "prefix_sums",
    "read_table", "scratch_path", "shared_folder", "write_file",
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A to Z in lower case, all other characters as they are. Texts of ASCII alone take the faster of two ways."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def sized(table: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A written table, to be broadcast if its rows at ``row_bytes`` each stay under ``limit``.

    Beyond that the join shuffles; the rows joined are the same.
    """
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # no such C library: memory stays with the process
        return lambda pad: 0


def give_back() -> None:
    """Free memory goes back to the system; Spark keeps Python workers for later tasks."""
    _trim()(0)


_CACHES: list[Callable[[], None]] = []
_OF_TASK: list[Callable[[], None]] = []


def cache(clear: Callable[[], None], task: bool = True) -> None:
    """Names what empties a cache of a worker process: at the end of a task, or when it turns to another operator."""
    _CACHES.append(clear)
    if task:
        _OF_TASK.append(clear)


_LAST: list[str] = [""]


def enter(operator: str) -> None:
    """Empties those caches when a worker turns to another operator, which needs the room for its own."""
    if _LAST[0] != operator:
        _LAST[0] = operator
        for clear in _CACHES:
            clear()
        give_back()


def byte_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column of each has about ``limit`` bytes.

    One text is never cut, so a slice may be as large as the longest text. After
    the last one the caches of the task are emptied: an idle worker stays small.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        width = np.dtype(np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32)
        ends = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        part = (ends[1:] - ends[0]) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(lo, hi - lo)
    for clear in _OF_TASK:
        clear()
    give_back()


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums of the lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class _WordHashes(dict):
    """Hash of each word met so far; emptied once it holds ``capacity`` words."""

    capacity = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.capacity:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _WordHashes()
cache(_HASHES.clear)


def hash_words(words: Sequence[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64, copy=True)
        v ^= v >> np.uint64(30)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(27)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(31)
    return v


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(word_hashes) - width + 1
    out = mix(word_hashes[:n])
    with np.errstate(over="ignore"):
        for i in range(1, width):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += word_hashes[i : i + n]
            if i % 2 == 0:
                out ^= out >> np.uint64(29)
    return mix(out)


def ordered_table(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``df`` written in ascending ``order`` (nulls first), with ``_pid`` and ``_pos``.

    ``_pid`` numbers the sorted parts, ``_pos`` the rows of a part. Equal rows
    are told apart by a row number fixed in a first written table, so a key
    that holds a large share of the rows spreads over many parts.
    """
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), f"{label}-rows")
    parts = rows.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row")
    placed = materialize(parts.drop("_row").withColumn("_mid", F.monotonically_increasing_id()), f"{label}-sorted")
    return placed.select(
        "*", F.shiftright("_mid", 33).alias("_pid"), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")
    ).drop("_mid")


def prefix_sums(placed: DataFrame, **values: Column) -> DataFrame:
    """For each named value the sum over all earlier rows of an ordered table.

    Windows see one sorted part, or one row per part.
    """
    names = list(values)
    rows = placed.withColumns({f"_v_{n}": c.cast("long") for n, c in values.items()})
    sums = rows.groupBy("_pid").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select("_pid", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in names])
    inside = W.partitionBy("_pid").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(carry, "_pid").withColumns(
        {n: F.col(f"_c_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names}
    )
    return out.drop("_pid", "_pos", *[f"_{k}_{n}" for k in "vsc" for n in names])


def _local(path: str) -> str | None:
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(folder: str, name: str, chunks: Iterator[bytes]) -> str:
    """One file in a shared folder under a name of its own; returns its path.

    A repeated task writes another file, and only the path that the successful
    attempt returns is read.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as out:
            for chunk in chunks:
                out.write(chunk)
        return path
    system, inner = _remote(folder)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner}/{path.rsplit('/', 1)[1]}") as out:
        for chunk in chunks:
            out.write(chunk)
    return path


def open_file(path: str):
    """A file of a shared folder for reading, with ``seek`` and ``read``."""
    if (local := _local(path)) is not None:
        return open(local, "rb")  # noqa: SIM115
    system, inner = _remote(path)
    return system.open_input_file(inner)


@lru_cache(maxsize=4096)
def local_copy(path: str) -> str:
    """A path that can be memory-mapped: the file itself, or a copy of a remote file."""
    if (local := _local(path)) is not None:
        return local
    name = os.path.join(tempfile.gettempdir(), re.sub(r"\W+", "_", path))
    if not os.path.exists(name):
        system, inner = _remote(path)
        part = f"{name}.{uuid.uuid4().hex}"
        with system.open_input_stream(inner) as src, open(part, "wb") as out:
            shutil.copyfileobj(src, out)
        os.replace(part, name)
    return name
