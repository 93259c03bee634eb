"""Token ids in files of compressed bit planes.

File format (little-endian): the chunks one after another, then the chunk
index, then a trailer of ``<QQ8s>`` (place of the index, number of chunks,
``MAGIC``). A chunk holds up to ``BLOCK`` ids. Its 32-bit ids are transposed
into planes: plane k has bit k (or byte k) of every id. Planes of zeros alone
are left out, each other plane is one zstandard frame. An index entry is
``<QIII``: place, ids, crc32 of the ids, planes; then ``<II`` for each plane,
its number and its compressed size.

The document table of a file is in further sections of the same form: document
lengths as 32-bit ids, then the bytes of all document names, and the length of each
name plus one (0: the name is null). Thus a reader finds every document from the file alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import tee

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraflow.llm.bpe import encoder
from terraflow.llm.common import byte_slices, materialize, open_file, scratch_path, write_file

MAGIC = b"BITPLAN2"
BLOCK = 1 << 16
IDS, LENGTHS, NAMES, NAME_LENGTHS = SECTIONS = range(4)


def to_planes(ids: np.ndarray, unit: str) -> list[tuple[int, bytes]]:
    """The planes of the ids that aren't all zeros, each with its number."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        planes = [rows[:, k] for k in range(4)]
    else:
        bits = np.unpackbits(rows, axis=1, bitorder="little").T
        planes = list(np.packbits(bits, axis=1, bitorder="little"))
    return [(k, p.tobytes()) for k, p in enumerate(planes) if p.any()]


def from_planes(planes: list[tuple[int, bytes]], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        rows = np.zeros((n, 4), np.uint8)
        for k, plane in planes:
            rows[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((32, n), np.uint8)
        for k, plane in planes:
            bits[k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        rows = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


class PlaneWriter:
    """Chunks of one file; ``add`` and ``close`` give the bytes to write."""

    def __init__(self, unit: str = "bit", block: int = BLOCK, level: int = 1):
        import zstandard

        self.unit, self.block = unit, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.place, self.index = 0, tuple([] for _ in SECTIONS)
        self.waiting: list[list[np.ndarray]] = [[] for _ in SECTIONS]

    def _chunk(self, section: int, ids: np.ndarray) -> bytes:
        planes = [(k, self.pack(p)) for k, p in to_planes(ids, self.unit)]
        entry = struct.pack("<QIII", self.place, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(planes))
        self.index[section].append(entry + b"".join(struct.pack("<II", k, len(p)) for k, p in planes))
        body = b"".join(p for _, p in planes)
        self.place += len(body)
        return body

    def _full(self, section: int, final: bool) -> Iterator[bytes]:
        held = np.concatenate(self.waiting[section]) if self.waiting[section] else np.empty(0, np.uint32)
        cut = len(held) if final else len(held) // self.block * self.block
        for lo in range(0, cut, self.block):
            yield self._chunk(section, held[lo : min(lo + self.block, cut)])
        self.waiting[section] = [held[cut:]]

    def add(self, ids: np.ndarray, lengths: np.ndarray, names: Sequence[str | None] = ()) -> Iterator[bytes]:
        """Documents: all their ids, how many each has, and their names."""
        raw = [None if x is None else x.encode() for x in names]
        self.waiting[IDS].append(ids)
        self.waiting[LENGTHS].append(lengths.astype(np.uint32))
        self.waiting[NAMES].append(np.frombuffer(b"".join(x or b"" for x in raw), np.uint8).astype(np.uint32))
        self.waiting[NAME_LENGTHS].append(np.array([0 if x is None else len(x) + 1 for x in raw], np.uint32))
        for section in SECTIONS:
            yield from self._full(section, False)

    def close(self) -> Iterator[bytes]:
        for section in SECTIONS:
            yield from self._full(section, True)
        counts = struct.pack("<2s4I", self.unit[:2].encode(), *map(len, self.index))
        yield counts + b"".join(x for entries in self.index for x in entries)
        yield struct.pack("<QQ8s", self.place, sum(map(len, self.index)), MAGIC)


class PlaneReader:
    """Reads chunks of a file in any order by its index."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        end = file.seek(0, 2)
        file.seek(end - 24)
        place, _, magic = struct.unpack("<QQ8s", file.read(24))
        if magic != MAGIC:
            raise ValueError("not a bit plane file")
        file.seek(place)
        index = file.read(end - 24 - place)
        unit, *counts = struct.unpack_from("<2s4I", index)
        self.unit, at = {b"bi": "bit", b"by": "byte"}[unit], 18
        self.sections: list[list[tuple]] = []
        for n in counts:
            entries = []
            for _ in range(n):
                where, ids, crc, planes = struct.unpack_from("<QIII", index, at)
                at += 20
                entries.append((where, ids, crc, [struct.unpack_from("<II", index, at + 8 * k) for k in range(planes)]))
                at += 8 * planes
            self.sections.append(entries)

    def chunk(self, section: int, number: int) -> np.ndarray:
        where, n, crc, planes = self.sections[section][number]
        self.file.seek(where)
        ids = from_planes([(k, self.unpack(self.file.read(size))) for k, size in planes], n, self.unit)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a chunk is damaged")
        return ids

    def chunks(self, section: int) -> Iterator[np.ndarray]:
        for k in range(len(self.sections[section])):
            yield self.chunk(section, k)

    def split(self, section: int, lengths: Iterator[int]) -> Iterator[np.ndarray]:
        """The numbers of a section, so many at a time."""
        source, held = self.chunks(section), np.empty(0, np.uint32)
        for n in lengths:
            parts, have = [held], len(held)
            while have < n:
                parts.append(next(source))
                have += len(parts[-1])
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield held[:n]
            held = held[n:]

    def documents(self) -> Iterator[tuple[str | None, np.ndarray]]:
        """Name and ids of each document."""
        numbers = lambda section: (n for c in self.chunks(section) for n in c.tolist())
        named, sizes = tee(numbers(NAME_LENGTHS))
        names = self.split(NAMES, (max(n - 1, 0) for n in sizes))
        for ids, name, size in zip(self.split(IDS, numbers(LENGTHS)), names, named, strict=True):
            yield name.astype(np.uint8).tobytes().decode() if size else None, ids


def write_corpus(docs: DataFrame, vocabulary: str, unit: str = "byte", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes all texts and writes their ids in ascending order of ``doc_id``.

    Returns the file table: ``part``, ``path`` (in the order of the corpus),
    ``n_docs`` and ``n_ids``. The files have everything else.
    Texts travel to their place in the order once, compressed; they are encoded there.
    Null text: the end id alone. Null ids come first. Rows with equal ids keep
    a fixed order. Bytes that aren't UTF-8 are read as the replacement character.
    No rows: no files. Extra columns are ignored.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "planes")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def squeeze(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pack(x) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "z"]
            )

    packed = materialize(rows.mapInArrow(squeeze, f"doc_id {kind}, z binary").withColumn("_row", F.monotonically_increasing_id()), "texts")
    ordered = packed.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row")

    def store(batches):
        import zstandard
        from pyspark import TaskContext

        unpack, codec, writer, seen = zstandard.ZstdDecompressor().decompress, encoder(vocabulary), PlaneWriter(unit), [0, 0]

        def body():
            for batch in byte_slices(batches, "z", 1 << 20):
                ids, starts = codec.encode([unpack(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()])
                seen[0] += batch.num_rows
                seen[1] += len(ids)
                yield from writer.add(ids, np.diff(starts), batch.column(0).to_pylist())
            yield from writer.close()

        part = TaskContext.get().partitionId()
        path = write_file(folder, f"part-{part:06d}", body())
        if seen[0]:
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [seen[0]], "n_ids": [seen[1]]})

    named = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "z")
    return materialize(named.mapInArrow(store, "part long, path string, n_docs long, n_ids long"), "plane-files")


def read_digest(files: DataFrame) -> DataFrame:
    """doc_id (as text), start, n_tokens and ids_crc32 of every document, from the files alone.

    What stands before a file is a sum over the file table, one row per file.
    """

    def load(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path) as file:
                    held: list[tuple] = []
                    for name, ids in PlaneReader(file).documents():
                        held.append((name, before, len(ids), zlib.crc32(ids.tobytes())))
                        before += len(ids)
                        if len(held) == 10_000:
                            yield _table(held)
                            held = []
                    yield _table(held)

    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = placed.repartition(tasks, "path")  # a number, so that small rows aren't merged into one task
    return spread.mapInArrow(load, "doc_id string, start long, n_tokens long, ids_crc32 long")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def corpus_digest(docs: DataFrame, vocabulary: str, unit: str = "byte", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the corpus and reads it back: one row per document with doc_id, start, n_tokens and ids_crc32.

    Nulls, repeated rows, empty tables and extra columns as in ``write_corpus``; ids
    of any type that comes back from text as it was (numbers, strings, dates).
    """
    found = read_digest(write_corpus(docs, vocabulary, unit, doc_id, text))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
