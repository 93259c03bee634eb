"""Interpolated modified Kneser-Ney bigrams over words.

Counted in Spark: tasks count their words and bigrams and send compressed
sorted runs, dealt by ranges of keys; one task sums a range and writes it as a
sorted array. Words are 64-bit hashes, and a word's number is the place of its
hash, so a bigram is one 64-bit key without collisions: number of the context,
number of the word. Ranges of bigrams are ranges of contexts, thus the counts
below a context stay in one place. A context with more than a thousandth of all
tokens (there are under a thousand) is dealt by its second word instead.

Workers memory-map the arrays. Probability of a word w after u:
``max(c(uw) - D(c), 0) / c(u) + g(u) * q(w)``, q from the number of different
contexts of w, discounted in the same way and interpolated with 1 / (V + 1).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraflow.llm.arrays import Part, SortedArrays, range_bucket, write_part
from terraflow.llm.common import byte_slices, cache, enter, hash_words, materialize, offsets_of, scratch_path
from terraflow.llm.packed import pack_run, unpack_run

END = b""  # no word is empty
FLUSH = 2_000_000
RUN = "bucket int, keys binary, counts binary"
FILE = "kind string, bucket int, path string, size long, total long, n1 long, n2 long, n3 long, n4 long, keys binary, counts binary"


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, an end after each text, and where texts start."""
    words = [t.lower().split() for t in texts]  # bytes: A-Z alone, ASCII white space alone
    for w in words:
        w.append(END)
    starts = offsets_of(np.fromiter(map(len, words), np.int64, len(words)))
    return hash_words([x for w in words for x in w]), starts


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _runs(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; the keys of a bucket come sorted."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    which, lo = np.unique(bucket, return_index=True)
    ends = np.append(lo[1:], len(bucket))
    packed = [pack_run(keys[a:b], counts[a:b]) for a, b in zip(lo.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(which.astype(np.int32)), pa.array([k for k, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())],
        ["bucket", "keys", "counts"],
    )


def _counted(values, to_bucket):
    """Runs of what ``values`` yields, counted ``FLUSH`` at a time."""
    held, size = [], 0
    for part in values:
        held.append(part)
        size += len(part)
        if size >= FLUSH:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield _runs(keys, counts.astype(np.uint64), to_bucket(keys))
            held, size = [], 0
    if size:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        yield _runs(keys, counts.astype(np.uint64), to_bucket(keys))


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _row(kind: str, part: Part | None, total: int = 0, n=(0, 0, 0, 0), bucket: int = 0, keys: bytes = b"", counts: bytes = b"") -> dict:
    return {
        "kind": kind, "bucket": part.bucket if part else bucket, "path": part.path if part else None, "size": part.size if part else 0,
        "total": total, "n1": n[0], "n2": n[1], "n3": n[2], "n4": n[3], "keys": keys, "counts": counts,
    }


def _table(rows: list[dict]) -> pa.Table:
    kinds = {"kind": pa.string(), "bucket": pa.int32(), "path": pa.string(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema([(k, kinds.get(k, pa.int64())) for k in _row("", None)]))


@dataclass
class Discounts:
    """D1, D2, D3 from the numbers of types counted once to four times."""

    n: tuple[int, int, int, int]

    def values(self) -> np.ndarray:
        n1, n2, n3, n4 = self.n
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return np.array([0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1))])

    def of(self, counts: np.ndarray) -> np.ndarray:
        return self.values()[np.minimum(counts, 3).astype(np.int64)]


@dataclass(frozen=True)
class Model:
    """What a task needs to open the model: files and a few numbers."""

    words: tuple[Part, ...]
    bigrams: tuple[Part, ...]
    contexts: tuple[Part, ...]
    continued: tuple[Part, ...]
    buckets: int
    tokens: int
    texts: int
    vocabulary: int
    hot: tuple[tuple[int, int, int, int], ...]  # number of a context, types counted once, twice, more often
    n_bigram: tuple[int, int, int, int]
    n_continued: tuple[int, int, int, int]
    continued_more: int  # words with three or more contexts


def id_bucket(ids: np.ndarray, vocabulary: int, buckets: int) -> np.ndarray:
    return ids.astype(np.int64) * buckets // (vocabulary + 1)


def bigram_bucket(keys: np.ndarray, vocabulary: int, buckets: int, hot: np.ndarray) -> np.ndarray:
    context = (keys >> np.uint64(32)).astype(np.int64)
    which = np.where(np.isin(context, hot), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), context) if len(hot) else context
    return id_bucket(which, vocabulary, buckets)


def word_counts(texts: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Sorted arrays of word hashes and counts."""

    def emit(batches):
        yield from _counted((tokens_of(b.column(0).to_pylist())[0] for b in byte_slices(batches, "text")), lambda k: range_bucket(k, buckets))

    def total(key, table):
        runs = [unpack_run(k, c) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        keys, counts = _summed([k for k, _ in runs], [c for _, c in runs])
        part = write_part(folder, key[0].as_py(), keys, counts)
        return _table([_row("words", part, int(counts.sum()))])

    return materialize(texts.mapInArrow(emit, RUN).groupBy("bucket").applyInArrow(total, FILE), "word-files")


def _parts(rows, dtype: str) -> tuple[Part, ...]:
    return tuple(Part(r["bucket"], r["path"], r["size"], dtype) for r in sorted(rows, key=lambda r: r["bucket"]))


def hot_words(words: tuple[Part, ...], buckets: int, tokens: int, spark) -> list[int]:
    """Numbers of the words with more than a thousandth of all tokens."""
    arrays = SortedArrays(words, buckets)
    bases = [(p.bucket, int(arrays.base[p.bucket])) for p in words]
    shared = (words, buckets, tokens)

    def scan(batches):
        parts, n, limit = shared
        opened = SortedArrays(parts, n)
        for batch in batches:
            found = [base + i for b, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i in np.flatnonzero(opened.part(b)[1] > limit // 1000).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["id"])

    table = spark.createDataFrame(bases, "bucket int, base long").repartition(min(len(bases), 64))
    return sorted(r["id"] for r in table.mapInArrow(scan, "id long").collect())


def train(texts: DataFrame) -> Model | None:
    """The model of a table with one binary column ``text``; None for an empty table."""
    spark = texts.sparkSession
    folder = scratch_path(spark, "word-lm")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = word_counts(texts, folder, buckets).collect()  # one row per file
    words = _parts(rows, "<u8")
    tokens, vocabulary = sum(r["total"] for r in rows), sum(p.size for p in words)
    if not tokens:
        return None
    n_texts = texts.count()
    hot = np.array(hot_words(words, buckets, tokens, spark), np.int64)
    ranges = max(buckets, tokens // 8_000_000 + 1)

    def emit(batches):
        enter("word_lm")
        table = SortedArrays(words, buckets)

        def keys():
            for batch in byte_slices(batches, "text"):
                flat, starts = tokens_of(batch.column(0).to_pylist())
                ids = numbers(table, buckets, flat)[0]
                before = np.roll(ids, 1)
                before[starts[:-1]] = vocabulary  # the start of a text
                yield (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)

        yield from _counted(keys(), lambda k: bigram_bucket(k, vocabulary, ranges, hot))

    def total(key, table):
        bucket = key[0].as_py()
        runs = [unpack_run(k, c) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        keys, counts = _summed([k for k, _ in runs], [c for _, c in runs])
        del runs
        out = [_row("bigrams", write_part(folder, bucket, keys, counts.astype("<u4")), 0, _of_counts(counts))]
        context = (keys >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        types = np.stack([np.add.reduceat((counts == 1).astype(np.int64), first), np.add.reduceat((counts == 2).astype(np.int64), first), np.add.reduceat((counts > 2).astype(np.int64), first)], axis=1)
        spread = np.isin(context[first], hot)
        out += [_row("hot", None, int(c), (*map(int, t), 0)) for c, t in zip(context[first][spread].tolist(), types[spread], strict=True)]
        fields = np.array([tuple(t) for t in types[~spread].tolist()], dtype="<u4,<u4,<u4")
        out.append(_row("contexts", write_part(folder, bucket, context[first][~spread].astype(np.uint64), fields)))
        word, times = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        runs = _runs(word, times.astype(np.uint64), id_bucket(word, vocabulary, ranges))
        out += [_row("words", None, 0, bucket=b, keys=k, counts=c) for b, k, c in zip(*(runs.column(i).to_pylist() for i in range(3)), strict=True)]
        return _table(out)

    def continued(key, table):
        runs = [unpack_run(k, c) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        keys, counts = _summed([k for k, _ in runs], [c for _, c in runs])
        part = write_part(folder, key[0].as_py(), keys, counts)
        return _table([_row("continued", part, int(counts.sum()), _of_counts(counts), counts=str(int((counts > 2).sum())).encode())])

    found = materialize(texts.mapInArrow(emit, RUN).groupBy("bucket").applyInArrow(total, FILE), "bigram-files")
    ended = materialize(found.filter("kind = 'words'").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(continued, FILE), "continued-files")
    files = found.filter("kind <> 'words'").collect()  # rows per file, and of hot contexts
    ends = ended.collect()
    of = lambda kind: [r for r in files if r["kind"] == kind]
    hot_types: dict[int, np.ndarray] = {}
    for r in of("hot"):
        hot_types[r["total"]] = hot_types.get(r["total"], np.zeros(3, np.int64)) + [r["n1"], r["n2"], r["n3"]]
    sums = lambda rows: tuple(sum(r[f"n{k}"] for r in rows) for k in (1, 2, 3, 4))
    return Model(
        words, _parts(of("bigrams"), "<u4"), _parts(of("contexts"), "<u4,<u4,<u4"), _parts(ends, "<u8"), buckets, tokens, n_texts, vocabulary,
        tuple((c, *map(int, t)) for c, t in sorted(hot_types.items())), sums(of("bigrams")), sums(ends), sum(int(r["counts"]) for r in ends),
    )


def numbers(table: SortedArrays, buckets: int, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (-1: unknown) and count of each word."""
    unique, inverse = np.unique(flat, return_inverse=True)
    ids, counts = table.find(unique, range_bucket(unique, buckets))
    return ids[inverse], counts[inverse]


class Scorer:
    """The opened model."""

    def __init__(self, model: Model):
        self.m = model
        self.words = SortedArrays(model.words, model.buckets)
        ranges = max(model.buckets, model.tokens // 8_000_000 + 1)
        self.ranges = ranges
        self.bigrams, self.contexts = SortedArrays(model.bigrams, ranges), SortedArrays(model.contexts, ranges)
        self.continued = SortedArrays(model.continued, ranges)
        self.hot = np.array([h[0] for h in model.hot], np.int64)
        self.d, self.d_continued = Discounts(model.n_bigram), Discounts(model.n_continued)
        self.types = sum(self._sum(p) for p in model.continued) or 1
        n1, n2 = model.n_continued[:2]
        self.uniform = float(self.d_continued.values()[1:] @ np.array([n1, n2, model.continued_more])) / self.types / (model.vocabulary + 1)

    def _sum(self, part: Part) -> int:
        return int(self.continued.part(part.bucket)[1].sum())

    def gamma(self, context: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Mass left to the words for each known context (sorted)."""
        bucket = id_bucket(context, self.m.vocabulary, self.ranges)
        types = np.zeros((len(context), 3))
        for b in np.unique(bucket).tolist():
            if b not in self.contexts.parts or not self.contexts.parts[b].size:
                continue
            rows = np.flatnonzero(bucket == b)
            keys, values = self.contexts.part(b)
            at = np.minimum(np.searchsorted(keys, context[rows].astype(np.uint64)), len(keys) - 1)
            ok = keys[at] == context[rows].astype(np.uint64)
            types[rows[ok]] = np.array(values[at[ok]].tolist(), np.float64).reshape(-1, 3)
        for c, *t in self.m.hot:
            types[np.searchsorted(context, c) : np.searchsorted(context, c, side="right")] = t
        return np.minimum(types @ self.d.values()[1:] / np.maximum(count, 1), 1.0)

    def score(self, texts: list[bytes]):
        """Per text: tokens, known tokens, base score and model score, both log10."""
        m = self.m
        flat, starts = tokens_of(texts)
        unique, inverse = np.unique(flat, return_inverse=True)
        ids, counts = self.words.find(unique, range_bucket(unique, m.buckets))
        base = np.log10((counts + 1) / (m.tokens + m.vocabulary + 1))
        known = ids >= 0
        cont = np.zeros(len(unique))
        order = np.flatnonzero(known)  # ids rise with the hashes
        _, cont[order] = self.continued.find(ids[order].astype(np.uint64), id_bucket(ids[order], m.vocabulary, self.ranges))
        q = np.maximum(cont - self.d_continued.of(cont), 0) / self.types + self.uniform
        g = np.ones(len(unique))
        g[order] = self.gamma(ids[order], counts[order])
        start_g = self.gamma(np.array([m.vocabulary]), np.array([m.texts]))[0]

        word = inverse
        before = np.roll(word, 1)
        first = np.zeros(len(word), bool)
        first[starts[:-1]] = True
        context = np.where(first, m.vocabulary, ids[before])
        of_context = np.where(first, m.texts, counts[before])
        p = np.where(first, start_g, g[before]) * q[word]
        both = np.flatnonzero(known[word] & (first | known[before]))
        keys, back = np.unique((context[both].astype(np.uint64) << np.uint64(32)) | ids[word[both]].astype(np.uint64), return_inverse=True)
        _, seen = self.bigrams.find(keys, bigram_bucket(keys, m.vocabulary, self.ranges, self.hot))
        gain = np.maximum(seen - self.d.of(seen), 0)[back]
        p[both] += gain / of_context[both]
        sums = lambda x: np.add.reduceat(x, starts[:-1])
        return np.diff(starts), sums(known[word].astype(np.int64)), sums(base[word]), sums(np.log10(p))


@lru_cache(maxsize=1)
def opened(model: Model) -> Scorer:
    return Scorer(model)


cache(opened.cache_clear)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Scores every text by a model of the documents outside one fold.

    The fold is crc32 of the doc_id as text (null: empty) modulo ``folds``.
    Null text is empty and has its end alone. Without training texts nothing
    is known and both scores are 0. Repeated rows count and are scored like any
    other; an empty table gives no rows; extra columns are ignored.
    """
    held = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold
    rows = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"))
    model = train(rows.filter(~F.col("held_out")).select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names of files and a few numbers

    def run(batches):
        enter("word_lm")
        m = shared.value
        for batch in byte_slices(batches, "text", 2 << 20):
            texts = batch.column(0).to_pylist()
            if m is None:
                n = np.array([len(t.split()) + 1 for t in texts])
                known, base, score = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
            else:
                n, known, base, score = opened(m).score(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(n), pa.array(known), pa.array(np.full(len(n), m.tokens if m else 0)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
