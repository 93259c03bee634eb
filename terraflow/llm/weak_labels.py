"""Quality classifier from weak labels.

Labellers look at figures of a text and vote: -1 bad, 1 good, 0 abstain. They
overlap and err. Expectation-maximisation over the numbers of each combination
of votes (counted in Spark over all documents) estimates how often each
labeller gives each vote on good, on poor and on hostile texts, and from that the
chance that a text is good. These posteriors train a linear scorer on hashed features: the
distinct words, and the figures in steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraflow.llm.common import byte_slices, enter, hash_words, materialize, offsets_of, sized

SLOTS = 1 << 18
#: Texts that the scorer is fitted on, about; the sample is by a hash of id and text.
FIT_ROWS = 15_000
#: Bytes of text that the scorer is fitted on, about; the smaller sample counts.
FIT_BYTES = 64 << 20
#: Default of the list that a caller may give; the registered query gives none and learns from labels alone.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")


@dataclass
class Figures:
    """Figures of the texts of a batch."""

    texts: list[bytes]
    hostile: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    words: np.ndarray = field(init=False)
    flat: np.ndarray = field(init=False)

    def __post_init__(self):
        split = [t.translate(_BARE).split() for t in self.texts]
        self.words = np.fromiter(map(len, split), np.int64, len(split))
        self.starts = offsets_of(self.words)
        self.flat = hash_words([x for w in split for x in w])
        doc = np.repeat(np.arange(len(split), dtype=np.uint64), self.words)
        slots = (doc << np.uint64(32)) | (self.flat & np.uint64(0xFFFFFFFF))
        self.pairs, times = np.unique(slots, return_counts=True)  # document and word, each once
        self.distinct = np.bincount((self.pairs >> np.uint64(32)).astype(np.int64), minlength=len(split))
        size = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        kinds = np.frombuffer(b"".join(self.texts), np.uint8)
        ends = offsets_of(size)
        count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[kinds], dtype=np.int64)])[ends])
        letters = count(_LETTER)
        per_word = 1 / np.maximum(self.words, 1)
        self.symbols = count(_SYMBOL) * per_word
        self.marks = count(_MARK) * per_word
        self.shouting = count(_UPPER) / np.maximum(letters, 1)
        self.letters = letters / np.maximum(size, 1)
        self.variety = self.distinct * per_word
        most = np.zeros(len(split))
        some = np.flatnonzero(self.distinct)
        if len(some):
            most[some] = np.maximum.reduceat(times, offsets_of(self.distinct)[some])
        self.top = most * per_word
        self.bars = count(_BAR) * per_word
        same = np.flatnonzero((self.flat[1:] == self.flat[:-1]) & (doc[1:] == doc[:-1]))
        self.echo = np.bincount(doc[same].astype(np.int64), minlength=len(split)) * per_word
        self.lines = np.array([_repeated(t) for t in self.texts])
        self.insults = np.bincount(np.repeat(np.arange(len(split)), self.words)[np.isin(self.flat, self.hostile)], minlength=len(split))


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_UPPER, _MARK, _SYMBOL, _BAR = _table(bytes(range(65, 91))), _table(b"!"), _table(b"#*$%&|<>"), _table(b"|<>")
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
#: Words are compared in lower case (A-Z) and without ASCII punctuation.
_BARE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def _repeated(text: bytes) -> float:
    """Share of the lines with text that repeat an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(lines) - len(set(lines))) / len(lines) if lines else 0.0


def bad_if(condition: np.ndarray) -> np.ndarray:
    return np.where(condition, -1, 0)


#: Kinds of texts that the label model tells apart.
GOOD, POOR, HOSTILE = range(3)
#: Name, kind of bad text that the labeller looks for, votes.
LABELLERS: tuple[tuple[str, int, Callable[[Figures], np.ndarray]], ...] = (
    ("symbols", POOR, lambda f: bad_if(f.symbols > 0.1)),
    ("bars", POOR, lambda f: bad_if(f.bars > 0.1)),
    ("letters", POOR, lambda f: bad_if((f.words >= 20) & (f.letters < 0.7))),
    ("shouting", POOR, lambda f: bad_if((f.words >= 5) & (f.shouting > 0.3))),
    ("marks", POOR, lambda f: bad_if((f.words >= 5) & (f.marks > 0.2))),
    ("variety", POOR, lambda f: np.where((f.words >= 20) & (f.variety < 0.45), -1, np.where((f.words >= 50) & (f.variety > 0.6), 1, 0))),
    ("one word", POOR, lambda f: bad_if((f.words >= 20) & (f.top > 0.2))),
    ("echo", POOR, lambda f: bad_if((f.words >= 20) & (f.echo > 0.05))),
    ("lines", POOR, lambda f: bad_if(f.lines > 0.3)),
    ("insults", HOSTILE, lambda f: bad_if(f.insults > 0)),
    ("insults again", HOSTILE, lambda f: bad_if(f.insults > 1)),
)


def votes_of(figures: Figures) -> np.ndarray:
    """One row per text, one column per labeller."""
    return np.stack([vote(figures) for _, _, vote in LABELLERS], axis=1).astype(np.int8)


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """Votes as digits of base 3."""
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, kinds: list[int], rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and rates[class, labeller, vote + 1].

    ``kinds`` has the class that each labeller looks for. Votes are independent
    given the class. The start, which also stays as a light prior, says that
    good texts are common and that labellers mostly find their own class.
    """
    labellers = len(kinds)
    digit = patterns[:, None] // 3 ** np.arange(labellers) % 3
    hot = (digit[:, :, None] == np.arange(3)).astype(np.float64)
    classes = [GOOD, *sorted(set(kinds))]
    prior = np.array([0.8, *[0.2 / (len(classes) - 1)] * (len(classes) - 1)])
    rates = np.tile(np.array([0.02, 0.88, 0.1]), (len(classes), labellers, 1))
    rates[0] = [0.01, 0.69, 0.3]
    for k, kind in enumerate(kinds):
        rates[classes.index(kind), k] = [0.5, 0.4, 0.1]
    pseudo = 0.001 * max(counts.sum(), 1) * rates
    good = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.log(prior) + np.einsum("plv,clv->pc", hot, np.log(rates))
        log -= log.max(axis=1, keepdims=True)
        post = np.exp(log) / np.exp(log).sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        rates = np.einsum("pc,plv->clv", weight, hot) + pseudo
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=0) + 1) / (counts.sum() + len(classes))
        if np.abs(post[:, 0] - good).max(initial=0) < 1e-9:
            break
        good = post[:, 0]
    return good, rates


def hostile_words(docs: DataFrame, labels: DataFrame, least: int = 4, share: float = 0.9, limit: int = 50_000) -> np.ndarray:
    """Hashes of the words, of any language, that stand in ``least`` or more toxic texts and hardly in others.

    ``labels`` has doc_id and toxic; about ``limit`` labelled rows are used, taken by a hash of the id.
    """
    known = labels.filter("toxic IS NOT NULL").select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).alias("toxic"))
    part = min(1.0, limit / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    known = materialize(known, "labelled")  # about ``limit`` rows, so the texts stay where they are
    rows = docs.select("text", "doc_id").join(sized(known, 24), F.col("doc_id") == F.col("id")).select("text", "toxic")

    def count(batches):
        for batch in byte_slices(batches, "text"):
            f = Figures(batch.column(0).to_pylist())
            toxic = np.array(batch.column(1).to_pylist(), bool)
            doc = np.repeat(np.arange(len(f.texts), dtype=np.uint64), f.words)
            order = np.lexsort((f.flat, doc))
            doc, word = doc[order].astype(np.int64), f.flat[order]
            once = np.ones(len(word), bool)
            once[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
            word, bad = word[once], toxic[doc[once]]
            unique, at = np.unique(word, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unique.view(np.int64)), pa.array(np.bincount(at, bad, len(unique)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(unique)))], ["word", "bad", "n"]
            )

    sums = rows.mapInArrow(count, "word long, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    found = sums.filter((F.col("bad") >= least) & (F.col("bad") >= share * F.col("n"))).select("word").collect()
    return np.unique(np.array([r[0] for r in found], np.int64).view(np.uint64))


# ---- Scorer ----


def features(f: Figures) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all texts one after another, and where each text starts. Every slot of a text counts 1."""
    doc = (f.pairs >> np.uint64(32)).astype(np.int64)
    word = ((f.pairs & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS)).astype(np.int64)
    steps = {
        "symbols": np.minimum(f.symbols * 20, 20), "marks": np.minimum(f.marks * 20, 20), "shouting": f.shouting * 20,
        "letters": f.letters * 20, "variety": f.variety * 20, "lines": f.lines * 10, "top": f.top * 20, "bars": np.minimum(f.bars * 20, 20),
        "echo": f.echo * 20, "hostile": f.insults,
    }
    extra = [np.array([_slot(name, s) for s in range(21)])[v.astype(np.int64).clip(0, 20)] for name, v in steps.items()]
    n = len(f.texts)
    doc = np.concatenate([doc, *[np.arange(n)] * len(extra)])
    slot = np.concatenate([word, *extra])
    order = np.argsort(doc, kind="stable")
    return slot[order], offsets_of(np.bincount(doc, minlength=n))


def _slot(name: str, step: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{name}={step}".encode()) % SLOTS


def fit(slots: np.ndarray, starts: np.ndarray, good: np.ndarray, rounds: int = 80, shrink: float = 1e-4) -> np.ndarray:
    """Logistic regression by full-batch adaptive steps; the last weight is the bias."""
    n = len(good)
    w, bias, squares, bias_squares = np.zeros(SLOTS), 0.0, np.full(SLOTS, 1e-8), 1e-8
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(np.add.reduceat(w[slots], starts[:-1]) + bias))) - good
        step = np.bincount(slots, np.repeat(off / n, np.diff(starts)), SLOTS) + shrink * w
        squares += step**2
        w -= 0.3 * step / np.sqrt(squares) * (step != 0)
        lean = off.mean()
        bias_squares += lean**2
        bias -= 0.3 * lean / bias_squares**0.5
    return np.append(w, bias)


# ---- Operator ----


def classify(
    docs: DataFrame, labels: DataFrame | None = None, insults: Sequence[str] = INSULTS, fit_rows: int = FIT_ROWS, least: float = 0.5,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, votes, posterior, score and kept (score of ``least`` or more) of every row.

    ``posterior`` is the label model's chance that the text is good, ``score``
    the scorer's. The words of the insult labellers are learned from ``labels``
    (doc_id, toxic), if given, and ``insults`` (single words in lower case) are
    added, which helps where few texts are labelled; without both these labellers abstain. The scorer is fitted on about
    ``fit_rows`` texts, ``FIT_BYTES`` at most, all else covers all rows. Ids may
    be of any type. Null text is empty, on which all labellers abstain. Repeated
    rows count and get repeated results; an empty table gives none; extra columns
    are ignored.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(body.alias("text"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), body).alias("draw"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    hostile = hash_words([w.encode() for w in insults])
    if labels is not None:
        hostile = np.union1d(hostile, hostile_words(rows, labels))

    def vote(batches):
        for batch in byte_slices(batches, "text", 2 << 20):
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(pattern_of(votes_of(Figures(texts, hostile)))), pa.array([len(t) for t in texts], pa.int64())], ["pattern", "size"])

    voted = rows.select("text").mapInArrow(vote, "pattern long, size long").groupBy("pattern")
    counted = voted.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).orderBy("pattern").collect()  # at most 3^labellers rows
    patterns, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.float64)
    good, _ = estimate(patterns, counts, [kind for _, kind, _ in LABELLERS])
    chance = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    share = min(1.0, fit_rows / max(counts.sum(), 1), FIT_BYTES / max(sum(r[2] for r in counted), 1))

    def train(batches):
        slots, sizes, target = [], [], []
        for batch in byte_slices(batches, "text", 2 << 20):
            f = Figures(batch.column(0).to_pylist(), hostile)
            s, starts = features(f)
            slots.append(s)
            sizes.append(np.diff(starts))
            target.append(np.array([chance.get(p, 0.5) for p in pattern_of(votes_of(f)).tolist()]))
        if slots:
            w = fit(np.concatenate(slots), offsets_of(np.concatenate(sizes)), np.concatenate(target))
            yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary())], ["weights"])

    # The fit enlarges rounding, so its rows come in one order however the table lies in files.
    sample = rows.filter(F.pmod("draw", F.lit(1 << 20)) < int(share * (1 << 20))).select("text", "draw")
    ordered = sample.repartition(1).sortWithinPartitions("draw", "text").select("text")
    fitted = materialize(ordered.mapInArrow(train, "weights binary"), "scorer").first()
    weights = np.frombuffer(fitted[0], "<f8") if fitted else np.zeros(SLOTS + 1)
    shared = docs.sparkSession.sparkContext.broadcast((weights, chance))  # SLOTS numbers and the patterns

    def score(batches):
        enter("weak_labels")
        w, known = shared.value
        for batch in byte_slices(batches, "text", 2 << 20):
            f = Figures(batch.column(0).to_pylist(), hostile)
            slots, starts = features(f)
            p = 1 / (1 + np.exp(-(np.add.reduceat(w[slots], starts[:-1]) + w[-1])))
            votes = votes_of(f)
            posterior = [known.get(x, 0.5) for x in pattern_of(votes).tolist()]
            text = ["".join("-.+"[v + 1] for v in row) for row in votes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(text), pa.array(posterior), pa.array(p), pa.array(p >= least)], ["doc_id", "votes", "posterior", "score", "kept"])

    return rows.select("text", "doc_id").mapInArrow(score, f"doc_id {id_type}, votes string, posterior double, score double, kept boolean")
