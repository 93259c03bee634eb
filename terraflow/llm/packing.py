"""Best-fit packing of token sequences by exact complements.

The plan works on the number of pieces of each length, never on the pieces: at
most ``size`` counts, whatever the corpus. Sums of one, two and three lengths are
looked up for combinations that fill a gap exactly; a combination is used as
often as its counts allow, so every step of the plan uses up at least one length
and the plan has fewer patterns than twice the lengths. What has no exact
complement gets the longest piece that fits. The pieces then find their place
by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraflow.llm.bpe import encoder
from terraflow.llm.common import byte_slices, materialize, ordered_table, prefix_sums


class Supply:
    """Counts of the lengths that are left, and lookups of exact sums."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths with this sum, the longer as long as can be."""
        b = np.arange(1, gap // 2 + 1)
        ok = (self.left[b] > 0) & (self.left[gap - b] > 0)
        if gap % 2 == 0 and len(b):
            ok[-1] = self.left[gap // 2] > 1
        return (gap - int(b[at]), int(b[at])) if len(b) and ok[at := int(np.argmax(ok))] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths with this sum."""
        for a in np.flatnonzero(self.left[: gap - 1])[::-1].tolist():
            self.left[a] -= 1
            two = self.pair(gap - a)
            self.left[a] += 1
            if two:
                return (a, *two)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if gap <= 0:
            return None
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often all these lengths can be taken together."""
        which, need = np.unique(lengths, return_counts=True)
        return int((self.left[which] // need).min())

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        np.subtract.at(self.left, list(lengths), times)


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have them.

    ``counts[n]`` is the number of pieces of length n, for 0 to ``size``.
    """
    supply, out = Supply(counts), []
    for n in range(size, 0, -1):
        while supply.left[n]:
            lengths: tuple[int, ...] = (n,)
            supply.left[n] -= 1
            taken: list[int] = [n]
            gap = size - n
            while gap:
                fit = supply.exact(gap)
                if fit is None:
                    below = np.flatnonzero(supply.left[: gap + 1])
                    fit = (int(below[-1]),) if len(below) else None
                if fit is None:
                    break
                supply.take(fit, 1)
                taken += fit
                lengths += fit
                gap -= sum(fit)
            more = supply.times(lengths)
            supply.take(lengths, more)
            out.append((lengths, more + 1))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows of (length, first rank, first sequence, offset), sorted; one per pattern and member.

    The piece of rank r has the last row of its length with first rank <= r;
    its sequence is first sequence + r - first rank.
    """
    rows, used, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def pieces(docs: DataFrame, vocabulary: str, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length and crc32 of its ids.

    A document of more than ``size`` ids is cut into pieces of ``size``; the
    first is what is left over. Null text is empty and gives the end id alone.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def cut(batches):
        codec = encoder(vocabulary)
        for batch in byte_slices(batches, "text", 2 << 20):
            ids, starts = codec.encode([x.decode("utf-8", "replace") for x in batch.column(1).to_pylist()])
            total = np.diff(starts)
            n = -(-total // size)
            first = total - (n - 1) * size
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            length = np.where(piece == 0, first[doc], size)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
            at = starts[doc] + start
            view = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(cut, f"doc_id {_kind(rows)}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, size: int = 2048) -> DataFrame:
    """Every piece with its sequence and its offset there.

    Null and repeated ids, of any type, and repeated rows are documents like any
    other; bytes that aren't UTF-8 are read as the replacement character; an
    empty table gives no rows; extra columns are ignored.
    """
    placed = ordered_table(materialize(pieces(docs, vocabulary, size), "pieces"), ["length", "doc_id", "piece"], "packing")
    counts = np.zeros(size + 1, np.int64)
    for n, k in placed.groupBy("length").count().collect():  # at most ``size`` rows
        counts[n] = k
    table = places(plan(counts, size))
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]  # pieces of smaller lengths
    # One number that sorts like (length, rank): places in the order of all pieces.
    first = table[:, 1] + before[table[:, 0]]

    def assign(batches):
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            row = np.searchsorted(first, rank, side="right") - 1
            sequence = table[row, 2] + rank - first[row]
            columns = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(table[row, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = prefix_sums(placed, rank=F.lit(1)).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(assign, f"doc_id {_kind(ranked)}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
