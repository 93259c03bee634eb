"""Exact n-gram Jaccard join with R-trees over count vectors.

A document is a point: its shingles are hashed into groups and counted. The sum
of the coordinate minima of two points bounds the overlap of their documents
from above, and so does the sum over a node's coordinate maxima for all points
below the node. Pairs that survive the bound are verified on the shingles.

One tree over a corpus would not prune (far-off documents of one size look alike
in few coordinates), so the points are first dealt out: two documents that link
share shingles in their prefixes under any common order, the more the longer the
prefixes. The order puts shingles that are frequent in the corpus last, by a
sketch of fixed size counted over all documents. Each shared prefix shingle is a
posting list, cut where the sizes of its documents are too far apart; equal
lists are worked once, documents that share too few shingles leave, and each
list is searched as a tree of its own.

Groups of copies would give all their pairs. Therefore documents are first
verified against a head of the list they share most shingles with, for some
rounds with other heads; the components of these links are known to the trees,
which then look only for pairs between different components. Every link
between different components is among these, so the components come out exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.llm.common import byte_slices, enter, hash_words, materialize, mix, offsets_of, shingle_hashes, sized
from terraflow.llm.graph import components

SKETCH = 1 << 21
BLOCK = 1 << 16
BITS = 1 << 24
GROUPS = 256
#: Points of a list that one task searches; longer lists are worked as pairs of parts.
PART = 2048
#: Points of a leaf of a tree.
LEAF = 32
#: Rounds of links to heads, and heads per list in the rounds after the first. They save pairs; the result is the same for any number.
ROUNDS = 4
HEADS = 4


def least_overlap(n: np.ndarray | int):
    """ceil(0.8 n): a linked document shares at least so many shingles."""
    return (4 * n + 4) // 5


def prefix_size(n: np.ndarray | int):
    """Two sets that link share 1 + m // 50 shingles of their prefixes, m the smaller size."""
    return n - least_overlap(n) + 1 + n // 50


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Smallest overlap at which sets of these sizes link: 9 * overlap >= 4 * (n + m)."""
    return (4 * (n + m) + 8) // 9


# ---- Shingles ----


class Shingled:
    """Normalised words and distinct shingles of the texts of a batch."""

    def __init__(self, texts: list[bytes], width: int):
        import xxhash

        words = [t.lower().split() for t in texts]  # bytes: A-Z alone, ASCII white space alone
        self.keys = [xxhash.xxh3_128_digest(b" ".join(w)) if w else b"" for w in words]
        self.refs = np.array([int.from_bytes(k[:8], "little", signed=True) for k in self.keys], np.int64)
        self.flat = hash_words([x for w in words for x in w])
        self.count = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(self.count)
        self.width = width

    def of(self, i: int) -> np.ndarray:
        """Sorted distinct shingle hashes of text ``i``; fewer words than the width are one shingle."""
        n = int(self.count[i])
        words = self.flat[int(self.end[i]) - n : int(self.end[i])]
        return np.unique(shingle_hashes(words, min(n, self.width) or 1)) if n else np.empty(0, np.uint64)


class Seen:
    """Keys met in this task, so that exact copies are worked once per task."""

    def __init__(self, limit: int = 500_000):
        self.keys: set[bytes] = set()
        self.limit = limit

    def first(self, key: bytes) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= self.limit:
            self.keys.clear()
        self.keys.add(key)
        return True


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), text_hash(F.col(text)).alias("text_hash"))


def text_hash(text: Column) -> Column:
    """A null text counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def _squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def shingled_documents(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key and n of every document, and blocks of the task's sketch (block, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]):
        enter("jaccard")
        sketch, seen, sizes = np.zeros(SKETCH, np.int64), Seen(), {}
        for batch in byte_slices(batches, "text"):
            part = Shingled(batch.column(1).to_pylist(), width)
            n = np.zeros(batch.num_rows, np.int64)
            for i, key in enumerate(part.keys):
                if seen.first(key) or key not in sizes:
                    if len(sizes) > seen.limit:
                        sizes.clear()
                    found = part.of(i)
                    sizes[key] = len(found)
                    np.add.at(sketch, (found & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                n[i] = sizes[key]
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(part.keys, pa.binary()), pa.array(n), none.cast(pa.int32()), none.cast(pa.binary())],
                ["doc_id", "text_hash", "key", "n", "block", "counts"],
            )
        for block in range(SKETCH // BLOCK):
            counts = sketch[block * BLOCK : (block + 1) * BLOCK]
            if counts.any():
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1).cast(k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.int64())), pa.array([block], pa.int32()), pa.array([_squeeze(counts)], pa.binary())],
                    ["doc_id", "text_hash", "key", "n", "block", "counts"],
                )

    return docs.mapInArrow(scan, "doc_id long, text_hash long, key binary, n long, block int, counts binary")


def _sum_blocks(blocks: DataFrame, dtype: type, combine) -> dict[int, np.ndarray]:
    """Blocks of one number combined; the result has a fixed size, whatever the input."""

    def total(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = _unsqueeze(blob, dtype)
                held[block] = combine(held[block], values) if block in held else values
        for block, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_squeeze(values)], pa.binary())], ["block", "counts"])

    spread = blocks.select("block", "counts").repartition(16, "block")
    return {r.block: _unsqueeze(r.counts, dtype) for r in spread.mapInArrow(total, "block int, counts binary").collect()}


def rarity_levels(table: DataFrame) -> np.ndarray:
    """For each place of the sketch 0 (rare) or a level that grows with the logarithm of its count."""
    blocks = _sum_blocks(table.filter("block IS NOT NULL"), np.int64, np.add)
    counts = np.zeros(SKETCH, np.int64)
    for block, values in blocks.items():
        counts[block * BLOCK : (block + 1) * BLOCK] = values
    mean = counts.mean()
    usual = mean + 6 * mean**0.5 + 8
    return np.ceil(np.log2(np.maximum(counts / usual, 1))).astype(np.uint8)


# ---- Posting lists of prefix shingles ----


def posting_lists(docs: DataFrame, levels: np.ndarray, width: int, buckets: int) -> DataFrame:
    """Members of the lists of documents that share a prefix shingle: sig, ref, n, tokens (shingles with this list)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # one byte for each place of the sketch

    def emit(batches):
        enter("jaccard")
        seen, waiting, held = Seen(), [], 0

        def flush():
            tokens = np.concatenate([t for t, _, _ in waiting])
            each = [len(t) for t, _, _ in waiting]
            refs = np.repeat(np.array([r for _, r, _ in waiting], np.int64), each)
            sizes = np.repeat(np.array([n for _, _, n in waiting], np.uint32), each)
            # Prefixes hold the smallest hashes, so the low half is what spreads evenly.
            bucket = ((tokens & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.lexsort((tokens, bucket))
            tokens, refs, sizes, bucket = tokens[order], refs[order], sizes[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if hi > lo]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in rows], pa.int32()),
                    pa.array([_squeeze(np.diff(tokens[lo:hi], prepend=np.uint64(0))) for _, lo, hi in rows], pa.binary()),
                    pa.array([refs[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
                    pa.array([_squeeze(sizes[lo:hi]) for _, lo, hi in rows], pa.binary()),
                ],
                ["bucket", "tokens", "refs", "sizes"],
            )

        for batch in byte_slices(batches, "text"):
            part = Shingled(batch.column(0).to_pylist(), width)
            for i, key in enumerate(part.keys):
                if not key or not seen.first(key):
                    continue
                found = part.of(i)
                level = shared.value[(found & np.uint64(SKETCH - 1)).astype(np.int64)]
                size = prefix_size(len(found))
                order = np.argsort(level, kind="stable")[:size] if level.any() else slice(0, size)
                waiting.append((found[order], part.refs[i], len(found)))
                held += size
            if held > 1_000_000:
                yield from flush()
                waiting, held = [], 0
        if waiting:
            yield from flush()

    def lists(key, table):
        tokens = np.concatenate([np.cumsum(_unsqueeze(b, np.uint64), dtype=np.uint64) for b in table.column("tokens").to_pylist()])
        refs = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("refs").to_pylist()])
        sizes = np.concatenate([_unsqueeze(b, np.uint32) for b in table.column("sizes").to_pylist()]).astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        many = tokens[order][1:] == tokens[order][:-1]
        order = order[np.append(many, False) | np.insert(many, 0, False)]
        order = order[np.lexsort((refs[order], sizes[order], tokens[order]))]
        tokens, refs, sizes = tokens[order], refs[order], sizes[order]
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (refs[1:] != refs[:-1])
        tokens, refs, sizes = tokens[keep], refs[keep], sizes[keep]
        new = np.ones(len(tokens), bool)  # sizes rise; no pair links across a gap
        new[1:] = (tokens[1:] != tokens[:-1]) | (5 * sizes[:-1] < 4 * sizes[1:])
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(tokens)))
        sig = _signatures(refs, starts)
        sig, first, times = np.unique(sig[count > 1], return_index=True, return_counts=True)
        at, size = starts[count > 1][first], count[count > 1][first]
        rows = np.repeat(at - offsets_of(size)[:-1], size) + np.arange(size.sum())
        return pa.table(
            {"sig": pa.array(np.repeat(sig.view(np.int64), size)), "ref": pa.array(refs[rows]), "n": pa.array(sizes[rows]), "tokens": pa.array(np.repeat(times.astype(np.int64), size))}
        )

    blobs = docs.select("text").mapInArrow(emit, "bucket int, tokens binary, refs binary, sizes binary")
    found = materialize(blobs.groupBy("bucket").applyInArrow(lists, "sig long, ref long, n long, tokens long"), "lists")
    members = found.groupBy("sig", "ref", "n").agg(F.sum("tokens").alias("tokens"))
    return materialize(members, "posting-lists")


def close_members(members: DataFrame) -> DataFrame:
    """Without the documents that share too few prefix shingles to link, and lists that have one member left."""
    m = F.floor((4 * F.col("n") + 4) / 5)
    enough = members.groupBy("ref", "n").agg(F.sum("tokens").alias("shared")).filter(F.col("shared") >= 1 + F.floor(m / 50))
    rows = materialize(members.join(enough.select("ref"), "ref", "left_semi"), "close")
    lists = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("sig")
    return materialize(rows.join(lists, "sig", "left_semi"), "close-members")


def _signatures(refs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(refs.view(np.uint64)), starts))


def heads(members: DataFrame, turn: int) -> DataFrame:
    """For members (sig, ref, tokens, label) outside of the largest component of a list a head inside of it: a, b.

    Heads are the first of that component in orders that change with ``turn``;
    of several lists, the head that shares most shingles counts, once per order.
    """
    order = F.xxhash64("label", F.lit(turn))
    largest = members.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("sig").agg(F.max_by("label", F.struct("k", order)).alias("main"))
    rows = members.join(largest, "sig")
    orders = [HEADS * turn + k for k in range(HEADS if turn else 1)]
    firsts = F.array(*[F.min_by("ref", F.xxhash64("ref", F.lit(k))) for k in orders])
    first = rows.filter("label = main").groupBy("sig").agg(firsts.alias("heads"))
    pairs = rows.filter("label <> main").join(first, "sig").select(F.posexplode("heads").alias("k", "a"), F.col("ref").alias("b"), "tokens")
    pairs = pairs.groupBy("a", "b", "k").agg(F.sum("tokens").alias("w"))
    best = pairs.groupBy("b", "k").agg(F.max_by("a", F.struct("w", F.xxhash64("a", "k"))).alias("a"))
    return best.select("a", "b").distinct()


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the lists that hold more than one component, with their labels."""
    if labels is None:
        return members.withColumn("label", F.col("ref"))
    known = labels.withColumnRenamed("node", "ref")
    rows = members.join(known, "ref", "left").withColumn("label", F.coalesce("label", "ref"))
    rows = materialize(rows, "list-members")
    lists = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig")
    return materialize(rows.join(lists, "sig", "left_semi"), "open-members")


def _rebatched(rows):
    """Joins the many small batches that ``rows`` yields."""

    def run(batches):
        held, size = [], 0
        for batch in rows(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


# ---- Sets and verification ----


def shingle_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """ref, key, n, set (sorted hashes) of the documents in any list, and perhaps of some others.

    A bitmap of fixed size says which documents to keep while the texts are read.
    """

    def mark(batches):
        bits = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            place = batch.column(0).to_numpy().view(np.uint64) & np.uint64(BITS - 1)
            np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), (1 << (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        for block in range(len(bits) // BLOCK):
            if (part := bits[block * BLOCK : (block + 1) * BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_squeeze(part)], pa.binary())], ["block", "counts"])

    blocks = _sum_blocks(members.select("ref").distinct().mapInArrow(mark, "block int, counts binary"), np.uint8, np.bitwise_or)
    bits = np.zeros(BITS // 8, np.uint8)
    for block, values in blocks.items():
        bits[block * BLOCK : (block + 1) * BLOCK] = values
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    def take(batches):
        enter("jaccard")
        seen = Seen()
        for batch in byte_slices(batches, "text"):
            part = Shingled(batch.column(0).to_pylist(), width)
            place = part.refs.view(np.uint64) & np.uint64(BITS - 1)
            marked = wanted.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            keep = [i for i in np.flatnonzero(marked).tolist() if part.keys[i] and seen.first(part.keys[i])]
            sets = [part.of(i) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.refs[keep]), pa.array([part.keys[i] for i in keep], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["ref", "key", "n", "set"],
            )

    found = docs.select("text").mapInArrow(take, "ref long, key binary, n long, set binary")
    return materialize(found.dropDuplicates(["ref", "key"]), "shingle-sets")


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts of the shingles in each group."""
    return np.bincount((hashes >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.int32)


def points_of(sets: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            blobs = [_squeeze(point(np.frombuffer(s, np.uint64))) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["ref", "n", "point"])

    return materialize(sets.select("ref", "n", "set").mapInArrow(run, "ref long, n long, point binary"), "points")


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs a, b whose sizes and coordinate minima allow a link."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            p = np.array([_unsqueeze(x, np.int32) for x in batch.column(3).to_pylist()]).reshape(-1, GROUPS)
            q = np.array([_unsqueeze(x, np.int32) for x in batch.column(5).to_pylist()]).reshape(-1, GROUPS)
            ok = np.minimum(p, q).sum(axis=1) >= needed(n, m)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])

    left = points.select(F.col("ref").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a"))
    right = points.select(F.col("ref").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b"))
    rows = pairs.join(left.select("a", "n_a"), "a").join(right.select("b", "n_b"), "b").filter("5 * n_a >= 4 * n_b AND 5 * n_b >= 4 * n_a")
    rows = rows.join(left.select("a", "p_a"), "a").join(right.select("b", "p_b"), "b").select("a", "b", "n_a", "p_a", "n_b", "p_b")
    return rows.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that link: 100 * shared >= 80 * all, counted on the shingles."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok[i] = 100 * both >= 80 * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])

    # Only the sets of these pairs travel.
    refs = materialize(pairs.select(F.explode(F.array("a", "b")).alias("ref")).distinct(), "pair-refs")
    sets = sets.join(sized(refs, 16), "ref", "left_semi")
    left, right = sets.select(F.col("ref").alias("a"), F.col("set").alias("s_a")), sets.select(F.col("ref").alias("b"), F.col("set").alias("s_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b")
    return materialize(rows.mapInArrow(run, "a long, b long"), "links")


# ---- Trees ----


class CountTree:
    """R-tree over count vectors, packed by size and then by the coordinate that spreads most."""

    def __init__(self, points: np.ndarray, n: np.ndarray, label: np.ndarray, leaf: int = LEAF):
        order, self.nodes = np.argsort(n, kind="stable"), []
        self.points, self.n, self.label = points, n, label
        self.root = self._build(order, leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        children: list[int] = []
        if len(rows) > leaf:
            n = self.n[rows]
            if n[-1] * 4 > n[0] * 5:
                split = rows
            else:
                split = rows[np.argsort(self.points[rows, int(np.argmax(self.points[rows].std(axis=0)))], kind="stable")]
            half = len(rows) // 2
            children = [self._build(np.sort(part) if split is not rows else part, leaf) for part in (split[:half], split[half:])]
        label = self.label[rows]
        same = int(label[0]) if (label == label[0]).all() else None
        self.nodes.append((self.points[rows].max(axis=0), int(self.n[rows].min()), int(self.n[rows].max()), same, children, rows))
        return len(self.nodes) - 1

    def near(self, q: np.ndarray, n: int, label: int) -> np.ndarray:
        """Rows of other labels whose size and bound allow a link with the point."""
        found, stack = [], [self.root]
        while stack:
            most, low, high, same, children, rows = self.nodes[stack.pop()]
            low = max(low, -(-4 * n // 5))
            if same == label or low > high or 4 * low > 5 * n or np.minimum(q, most).sum() < needed(n, low):
                continue
            if children:
                stack += children
                continue
            m = self.n[rows]
            ok = (self.label[rows] != label) & (5 * m >= 4 * n) & (4 * m <= 5 * n)
            ok &= np.minimum(q, self.points[rows]).sum(axis=1) >= needed(n, m)
            found.append(rows[ok])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def tree_pairs(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs a, b of different components that share a list and survive the bounds; ``rows`` are labelled members.

    A pair that shares several lists comes out of the one with the smallest sig.
    """
    spark = rows.sparkSession
    lists_of = rows.groupBy("ref").agg(F.array_sort(F.collect_set("sig")).alias("sigs"))
    # A list of more than PART points is worked as pairs of parts, so no task gets all of it.
    sizes = rows.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    rows = rows.join(sizes, "sig").withColumn("part", F.pmod(F.xxhash64("ref"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    units = rows.select("sig", "ref", "n", "label", "part", F.explode(others).alias("u"))
    units = units.select(F.xxhash64("sig", "u.i", "u.j").alias("unit"), "sig", "ref", "n", "label", "part", (F.col("u.i") == F.col("u.j")).alias("whole"))
    units = units.join(points.select("ref", "point"), "ref").join(lists_of, "ref")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def search(batches):
        enter("jaccard")
        for table in _whole_units(batches):
            unit, sig, ref, n, label, part = (table.column(c).to_numpy() for c in ("unit", "sig", "ref", "n", "label", "part"))
            whole = table.column("whole").to_numpy(zero_copy_only=False)
            sigs = table.column("sigs").combine_chunks()
            at, of = sigs.offsets.to_numpy(), sigs.values.to_numpy()
            vectors = np.array([_unsqueeze(x, np.int32) for x in table.column("point").to_pylist()]).reshape(-1, GROUPS)
            cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                kinds, count = np.unique(label[lo:hi], return_counts=True)
                if len(kinds) == 1:
                    continue
                if hi - lo <= LEAF:  # a tree of one leaf: all its pairs at once
                    p, q = np.triu_indices(hi - lo, 1)
                    p, q = p + lo, q + lo
                    ok = (label[p] != label[q]) & (5 * n[p] >= 4 * n[q]) & (4 * n[p] <= 5 * n[q]) & ((part[p] != part[q]) | whole[p])
                    p, q = p[ok], q[ok]
                    ok = np.minimum(vectors[p], vectors[q]).sum(axis=1) >= needed(n[p], n[q])
                    for x, y in zip(p[ok].tolist(), q[ok].tolist(), strict=True):
                        if np.intersect1d(of[at[x] : at[x + 1]], of[at[y] : at[y + 1]], assume_unique=True)[0] == sig[x]:
                            yield pa.RecordBatch.from_arrays([pa.array([min(ref[x], ref[y])]), pa.array([max(ref[x], ref[y])])], ["a", "b"])
                    continue
                # One end of every pair lies outside of the largest component.
                outside = label[lo:hi] != kinds[np.argmax(count)]
                tree = CountTree(vectors[lo:hi], n[lo:hi], label[lo:hi])
                for i in np.flatnonzero(outside).tolist():
                    x = lo + i
                    near = tree.near(vectors[x], int(n[x]), int(label[x]))
                    near = lo + near[~outside[near] | (ref[lo + near] > ref[x])]
                    near = near[(part[near] != part[x]) | whole[x]]
                    own = of[at[x] : at[x + 1]]
                    keep = [y for y in near.tolist() if np.intersect1d(own, of[at[y] : at[y + 1]], assume_unique=True)[0] == sig[x]]
                    if keep:
                        other = ref[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, ref[x])), pa.array(np.maximum(other, ref[x]))], ["a", "b"])

    spread = units.repartition(tasks, "unit").sortWithinPartitions("unit")
    columns = ("unit", "sig", "ref", "n", "label", "part", "whole", "sigs", "point")
    return spread.select(*columns).mapInArrow(_rebatched(search), "a long, b long")


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole units; the rows come sorted by unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column(0).to_numpy()
        cut = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
        if cut or (held and len(unit) and held[-1].column(0)[-1].as_py() != unit[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


# ---- Join ----


def join_components(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, key and text_hash of every row.

    Two documents link when their sets of ``width``-word shingles have a Jaccard
    similarity of 0.8 or more; words end at ASCII white space, A-Z count as a-z.
    A text of fewer words is one shingle. A null or wordless text has no
    shingle, links with nothing and is its own component, also when repeated.
    The component is named after its smallest doc_id, null if all are null.
    """
    rows = _texts(docs, doc_id, text)
    table = materialize(shingled_documents(rows, width), "documents")
    found = table.filter("block IS NULL").select("doc_id", "text_hash", "key", F.col("n").alias("n_shingles"))
    total = found.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 3_000_000 + 1)
    members = close_members(posting_lists(rows, rarity_levels(table), width, buckets))
    sets = shingle_sets(rows, members, width)
    points = points_of(sets)
    labels, links, last = None, None, None
    for turn in range(ROUNDS):
        rest = labelled(members, labels)
        count = rest.agg(F.count_distinct("label")).first()[0]
        if not count or (last is not None and count > 0.95 * last):
            break
        last = count
        new = verified(materialize(bounded(heads(rest, turn), points), "head-pairs"), sets)
        links = new if links is None else links.union(new)
        labels = components(links)
    if links is None:
        links = docs.sparkSession.createDataFrame([], "a long, b long")
        labels = components(links)
    more = verified(materialize(tree_pairs(labelled(members, labels), points), "tree-pairs"), sets)
    labels = components(links.union(more))

    names = sets.select("key", "ref").join(labels, sets["ref"] == labels["node"]).select("key", F.col("label"))
    keyed = found.groupBy("key").agg(F.min("doc_id").alias("low")).join(names, "key", "left").filter("key <> X''")
    classes = keyed.withColumn("class", F.coalesce(F.col("label").cast("string"), F.hex("key")))
    smallest = classes.groupBy("class").agg(F.min("low").alias("component_id"))
    named = materialize(classes.join(smallest, "class").select("key", "component_id"), "key-components")
    return found.join(named, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.length("key") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "text_hash"
    )


def one_of_each(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one whose doc_id names it.

    Of several texts with that id the one with the smallest hash stays. Rows
    equal in id and text are one document and stay once. Documents without
    words link with nothing and all stay.
    """
    found = materialize(join_components(docs, width, doc_id, text), "components")
    chosen = found.filter("key <> X''").groupBy("component_id").agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("text_hash"))).alias("text_hash")
    )
    chosen = chosen.union(found.filter("key = X''").select("doc_id", "text_hash").distinct())
    chosen = chosen.select(F.col("component_id").alias("__id"), F.col("text_hash").alias("__hash"))
    hashed = docs.withColumn("__text_hash", text_hash(F.col(text)))
    kept = hashed.join(
        sized(materialize(chosen, "chosen"), 32), F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi"
    )
    if not found.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id, "__text_hash"])
    return kept.select(docs.columns)
