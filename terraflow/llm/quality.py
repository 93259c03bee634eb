"""Quality rules by n-gram perplexity, with bands for each language.

Each language gets an interpolated modified Kneser-Ney model over characters
(``ORDER`` of them), so its size follows the alphabet and not the corpus. Tasks count
the n-grams of their texts; sums, continuation counts, discounts and
interpolated probabilities are joins and groupings of n-gram tables. The
probabilities go to sorted hash arrays in the shared folder.

A document's log-perplexity per word, and per word with a letter, is then compared
with its language: the median and, on each side, the median distance from it, over
all documents that pass the base rules, give an upper and a lower bound. Noise,
symbols and foreign text are above, and text of letters and scraps is below. Bars
and numbers between words are cheap words that hide noise in the first mean; the
second one gives their cost to the words beside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraflow.llm.arrays import Part, SortedArrays, range_bucket, write_part
from terraflow.llm.common import byte_slices, cache, enter, hash_words, materialize, mix, offsets_of, scratch_path, shingle_hashes, sized

ORDER = 4
START, END = 1, 2
SYMBOLS = b"#*$%&|<>"
#: From the first letter of a word to its end: one match for each word with a letter.
LETTER_WORD = re.compile(r"[^\W\d_][^\x20\x09-\x0D]*")
STEP = 0.001  # nats; bands are read from a histogram of this width


# ---- Counting ----


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ``ORDER``-grams of all characters and the end of each text, and where texts start.

    A character counts with 16 bits of its code point; start marks stand before a text.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = ORDER - 1
    code = np.frombuffer("".join(["\x01" * pad + t + "\x02" for t in texts]).encode("utf-32-le"), "<u4").astype(np.uint64) & np.uint64(0xFFFF)
    np.maximum(code, 3, out=code)
    first = offsets_of(size + ORDER)[:-1]
    for k in range(pad):
        code[first + k] = START
    code[first + pad + size] = END
    n = len(code) - pad
    key = code[:n].copy()
    for k in range(1, ORDER):
        key <<= np.uint64(16)
        key |= code[k : k + n]
    keep = np.ones(n, bool)
    for k in range(pad):
        keep[(first[1:] - 1 - k)] = False
    return key[keep], offsets_of(size + 1)


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Language, rows and texts; columns text and lang."""
    lang = np.array(batch.column("lang").to_pylist(), object)
    texts = np.array([t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()] + [None], object)[:-1]
    for name in sorted(set(lang.tolist())):
        rows = np.flatnonzero(lang == name)
        yield name, rows, texts[rows].tolist()


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, g, c over all texts; ``rows`` has text (binary) and lang."""

    def emit(batches):
        enter("quality")
        held: dict[str, list] = {}
        for batch in byte_slices(batches, "text", 2 << 20):
            for lang, _, texts in by_language(batch):
                held.setdefault(lang, []).append(np.unique(grams(texts)[0], return_counts=True))
                if len(held[lang]) >= 16:
                    held[lang] = [_merged(held[lang])]
        for lang, parts in held.items():
            keys, counts = _merged(parts)
            for lo in range(0, len(keys), 65536):
                k = keys[lo : lo + 65536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(counts[lo : lo + 65536])], ["lang", "g", "c"]
                )

    return rows.mapInArrow(emit, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _merged(parts) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, counts, len(unique)).astype(np.int64)


# ---- Model ----


def probabilities(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each order lang, g, p; for each length of context lang, g, left (the mass left to shorter contexts).

    Shorter n-grams count with the number of different characters before them.
    """
    tables = [counts]
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << 16 * n) - 1))
        tables.insert(0, materialize(tables[0].groupBy("lang", suffix.alias("g")).agg(F.count(F.lit(1)).alias("c")), f"grams-{n}"))
    lower = None
    levels, contexts = [], []
    for n, table in enumerate(tables, 1):
        k = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        cuts = table.groupBy("lang").agg(*k, F.count(F.lit(1)).alias("types")).select(
            "lang",
            "types",
            *[
                F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05 * i)), F.lit(0.95 * i)))
                .otherwise(0.5 * i)
                .alias(f"d{i}")
                for i in (1, 2, 3)
            ],
        )
        cuts = sized(materialize(cuts, f"discounts-{n}"), 100)
        rows = table.withColumn("context", F.shiftrightunsigned("g", 16)).join(cuts, "lang")
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("cut", cut)
        sums = rows.groupBy("lang", "context").agg(F.sum("c").alias("all"), F.sum("cut").alias("cuts"))
        sums = materialize(sums.select("lang", "context", "all", (F.col("cuts") / F.col("all")).alias("left")), f"contexts-{n}")
        rows = rows.join(sums, ["lang", "context"])
        if lower is None:
            below = 1 / (F.col("types") + 1)
        else:
            rows = rows.withColumn("suffix", F.col("g").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1)))
            rows = rows.join(lower.select("lang", F.col("g").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
            below = F.col("below")
        lower = materialize(rows.select("lang", "g", ((F.col("c") - F.col("cut")) / F.col("all") + F.col("left") * below).alias("p")), f"p-{n}")
        levels.append(lower)
        contexts.append(sums.select("lang", F.col("context").alias("g"), "left"))
    return levels, contexts


def array_keys(lang: np.ndarray, g: np.ndarray, salt: int) -> np.ndarray:
    return mix(g ^ mix(lang + np.uint64(salt)))


@lru_cache(maxsize=4096)
def language_hash(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) & ((1 << 63) - 1)


def store(levels: list[DataFrame], contexts: list[DataFrame], folder: str, buckets: int) -> tuple[Part, ...]:
    """All probabilities (salt: order) and left masses (salt: 16 + length of context) as one set of sorted arrays."""
    rows = None
    for kind, tables in ((1, levels), (16, contexts)):
        for n, t in enumerate(tables):
            part = t.select("lang", "g", F.lit(kind + n).alias("salt"), F.col(t.columns[2]).cast("double").alias("v"))
            rows = part if rows is None else rows.union(part)

    def hashed(batches):
        for batch in batches:
            lang = np.fromiter((language_hash(x) for x in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            salt = batch.column(2).to_numpy().astype(np.uint64)
            h = mix(batch.column(1).to_numpy().view(np.uint64) ^ mix(lang + salt))
            yield pa.RecordBatch.from_arrays([pa.array(range_bucket(h, buckets).astype(np.int32)), pa.array(h.view(np.int64)), batch.column(3)], ["bucket", "h", "v"])

    def write(key, table):
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        part = write_part(folder, key[0].as_py(), h[order], table.column("v").to_numpy()[order])
        return pa.table({"bucket": pa.array([part.bucket], pa.int32()), "path": [part.path], "size": pa.array([part.size], pa.int64())})

    keyed = rows.mapInArrow(hashed, "bucket int, h long, v double").groupBy("bucket")
    files = materialize(keyed.applyInArrow(write, "bucket int, path string, size long"), "gram-files")
    return tuple(Part(r["bucket"], r["path"], r["size"], "<f8") for r in files.orderBy("bucket").collect())


class GramModel:
    """Opened arrays with a table of first places, so that a lookup is a few comparisons."""

    def __init__(self, parts: tuple[Part, ...], buckets: int):
        arrays = SortedArrays(parts, buckets)
        opened = [arrays.part(p.bucket) for p in sorted(parts, key=lambda p: p.bucket)]
        self.keys = np.concatenate([k for k, _ in opened]) if opened else np.empty(0, np.uint64)
        self.values = np.concatenate([v for _, v in opened]) if opened else np.empty(0)
        bits = max(1, min(24, int(len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.deepest = int(np.diff(self.first).max()) if len(self.keys) else 0
        self.buckets = buckets

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values, NaN where a key is missing."""
        out = np.full(len(h), np.nan)
        if not len(self.keys):
            return out
        at = self.first[(h >> self.shift).astype(np.int64)]
        left = np.arange(len(h))
        for _ in range(self.deepest):
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == h[left]
            out[left[hit]] = self.values[at[hit]]
            at, left = at[~hit] + 1, left[~hit]
            if not len(left):
                break
        return out

    def log_p(self, lang: str, keys: np.ndarray) -> np.ndarray:
        name = np.full(1, language_hash(lang), np.uint64)
        p = self.find(array_keys(name, keys, ORDER))
        missing = np.flatnonzero(np.isnan(p))
        weight = np.ones(len(missing))
        for n in range(ORDER - 1, -1, -1):
            if not len(missing):
                break
            context = (keys[missing] & np.uint64((1 << 16 * (n + 1)) - 1)) >> np.uint64(16)
            left = self.find(array_keys(name, context, 16 + n))
            weight = weight * np.where(np.isnan(left), 1.0, left)
            if not n:
                p[missing] = weight / (1 << 16)  # a character that the language has never shown
                break
            lower = self.find(array_keys(name, keys[missing] & np.uint64((1 << 16 * n) - 1), n))
            ok = ~np.isnan(lower)
            p[missing[ok]] = (weight * lower)[ok]
            missing, weight = missing[~ok], weight[~ok]
        return np.log(p)


@lru_cache(maxsize=1)
def opened(parts: tuple[Part, ...], buckets: int) -> GramModel:
    return GramModel(parts, buckets)


cache(opened.cache_clear)


# ---- Base rules ----


def base_figures(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = [t.split() for t in texts]  # bytes: ASCII white space alone
    n = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.fromiter((len(b" ".join(w).decode("utf-8", "replace")) for w in words), np.int64, len(words)) - np.maximum(n - 1, 0)
    symbols = np.fromiter((sum(map(t.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))) for t in texts), np.int64, len(texts))
    again = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip()]
            again[i] = len(lines) - len(set(lines))
    flat = hash_words([x for w in words for x in w])
    starts = offsets_of(n)
    covered = np.zeros(len(flat) + 3, bool)
    if len(flat) >= 3:
        doc = np.repeat(np.arange(len(n)), n)
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        h = shingle_hashes(flat, 3)[inside] ^ mix(doc[inside].astype(np.uint64))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        for k in range(3):
            covered[at + k] = True
    sums = np.concatenate([[0], np.cumsum(covered[: len(flat)])])
    return n, chars, symbols, again, sums[starts[1:]] - sums[starts[:-1]]


# ---- Rules ----


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORES = {"log_perplexity": ("low", "high"), "letter_perplexity": ("letter_low", "letter_high")}
NAMES = ("_pick", "doc_id", "lang", *FIGURES, "n_letter_words", *SCORES)


def scored(rows: DataFrame, parts: tuple[Part, ...], buckets: int) -> DataFrame:
    """Base figures and log-perplexity per word and per word with a letter of every row; ``rows`` has text, lang, doc_id and _pick."""

    def run(batches):
        enter("quality")
        model = opened(parts, buckets)
        for batch in byte_slices(batches, "text", 1 << 20):
            figures = base_figures(batch.column("text").to_pylist())
            total, letters = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lang, at, texts in by_language(batch):
                keys, starts = grams(texts)
                total[at] = -np.add.reduceat(model.log_p(lang, keys), starts[:-1])
                letters[at] = [len(LETTER_WORD.findall(t)) for t in texts]
            means = [total / np.maximum(n, 1) for n in (figures[0], letters)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_pick"), batch.column("doc_id"), batch.column("lang"), *map(pa.array, (*figures, letters, *means))], list(NAMES)
            )

    longs = ", ".join(f"{n} long" for n in (*FIGURES, "n_letter_words"))
    doubles = ", ".join(f"{n} double" for n in SCORES)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_pick long, doc_id {kind}, lang string, {longs}, {doubles}")


def bands(rows: DataFrame, width: float, least: float, low_width: float, low_least: float) -> DataFrame:
    """lang and the bounds of both scores: the median plus ``width`` and minus ``low_width`` robust deviations of its own side, ``least`` and ``low_least`` nats at least."""
    scores = F.explode(F.create_map(*[x for name in SCORES for x in (F.lit(name), F.col(name))])).alias("score", "x")
    bins = rows.filter("NOT base_failed").select("lang", scores).groupBy("lang", "score", F.round(F.col("x") / STEP).cast("long").alias("b")).count()
    bins = materialize(bins, "perplexity-bins")
    middle = bins.groupBy("lang", "score").agg(F.percentile("b", F.lit(0.5), F.col("count")).alias("m"))
    off = F.col("b") - F.col("m")
    below, above = (F.percentile(F.when(x >= 0, x), F.lit(0.5), F.col("count")) for x in (-off, off))
    sides = bins.join(middle, ["lang", "score"]).groupBy("lang", "score", "m").agg(below.alias("below"), above.alias("above"))
    low = F.col("m") * STEP - F.greatest(F.lit(low_width * 1.4826) * F.col("below") * STEP, F.lit(low_least))
    high = F.col("m") * STEP + F.greatest(F.lit(width * 1.4826) * F.col("above") * STEP, F.lit(least))
    bounds = [F.max(F.when(F.col("score") == name, x)).alias(n) for name, names in SCORES.items() for n, x in zip(names, (low, high), strict=True)]
    return materialize(sides.groupBy("lang").agg(*bounds), "bands")


def judge(
    docs: DataFrame, width: float = 10.0, least: float = 2.4, low_width: float = 6.0, low_least: float = 1.2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """doc_id, base figures, n_letter_words, base_failed, both scores with their bounds, kept and text_hash of every row.

    Null text is empty; a null language is a language of its own. Ids are of any
    type; bytes that aren't UTF-8 become the replacement character. A language
    without a document that passes the base rules has no band and nothing more
    to reject. Repeated rows get repeated results; an empty table gives none;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(body.alias("text"), F.coalesce(F.make_valid_utf8(F.col(lang).cast("string")), F.lit("")).alias("lang"), F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("_pick"))
    counts = materialize(gram_counts(rows.select("text", "lang")), "grams")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = store(*probabilities(counts), scratch_path(spark, "gram-model"), buckets)
    found = scored(rows, parts, buckets).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    found = materialize(found, "quality")
    limits = bands(found, width, least, low_width, low_least)
    inside = F.lit(True)
    for name, (low, high) in SCORES.items():
        inside &= F.col(low).isNull() | F.col(name).between(F.col(low), F.col(high))
    return found.join(sized(limits, 64), "lang", "left").select(
        "doc_id", *FIGURES, "n_letter_words", "base_failed", *[c for name, bounds in SCORES.items() for c in (name, *bounds)], (~F.col("base_failed") & inside).alias("kept"), F.col("_pick").alias("text_hash")
    )


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, with all their columns, that the rules keep. The verdict follows from text and language."""
    judged = judge(docs, doc_id=doc_id, text=text, lang=lang)
    bad = materialize(judged.filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "rejected")
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    return hashed.join(sized(bad, 32), same, "left_anti").select(docs.columns)
