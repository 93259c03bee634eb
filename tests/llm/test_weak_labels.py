"""Votes, posteriors and scores of the weak-label classifier beside plain loops."""

import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from terraflow.llm import weak_labels
from terraflow.llm.common import hash_words

SF = "/root/testdata/sf0.001"


def words_of(text):
    return bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in text).split()


def figures(text, hostile):
    words = words_of(text)
    n, held = max(len(words), 1), Counter(words)
    among = lambda chars: sum(b in chars for b in text)
    letters = sum(chr(b).isalpha() if b < 128 else True for b in text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return {
        "words": len(words), "symbols": among(b"#*$%&|<>") / n, "bars": among(b"|<>") / n, "marks": among(b"!") / n,
        "shouting": sum(65 <= b <= 90 for b in text) / max(letters, 1), "letters": letters / max(len(text), 1),
        "variety": len(held) / n, "top": max(held.values(), default=0) / n, "echo": sum(a == b for a, b in zip(words, words[1:])) / n,
        "lines": (len(lines) - len(set(lines))) / len(lines) if lines else 0.0, "hostile": sum(w in hostile for w in words),
    }


def votes(f):
    many = f["words"] >= 20
    bad = [
        f["symbols"] > 0.1, f["bars"] > 0.1, many and f["letters"] < 0.7, f["words"] >= 5 and f["shouting"] > 0.3, f["words"] >= 5 and f["marks"] > 0.2,
        many and f["variety"] < 0.45, many and f["top"] > 0.2, many and f["echo"] > 0.05, f["lines"] > 0.3, f["hostile"] > 0, f["hostile"] > 1,
    ]
    out = ["-" if b else "." for b in bad]
    if out[5] == "." and f["words"] >= 50 and f["variety"] > 0.6:
        out[5] = "+"
    return "".join(out)


def posteriors(patterns):
    """Chance of good of each pattern: classes good, poor, hostile; votes independent given the class."""
    kinds = [1] * 9 + [2] * 2
    total = sum(patterns.values())
    start = [[{"-": 0.01, ".": 0.69, "+": 0.3} if c == 0 else {"-": 0.5, ".": 0.4, "+": 0.1} if kinds[k] == c else {"-": 0.02, ".": 0.88, "+": 0.1} for k in range(11)] for c in range(3)]
    rates, prior, good = start, [0.8, 0.1, 0.1], dict.fromkeys(patterns, 0.5)
    for _ in range(300):
        post = {}
        for p in patterns:
            like = [prior[c] * math.prod(rates[c][k][v] for k, v in enumerate(p)) for c in range(3)]
            post[p] = [x / sum(like) for x in like]
        rates = []
        for c in range(3):
            rates.append([])
            for k in range(11):
                sums = {v: 0.001 * total * start[c][k][v] for v in "-.+"}
                for p, n in patterns.items():
                    sums[p[k]] += n * post[p][c]
                rates[c].append({v: x / sum(sums.values()) for v, x in sums.items()})
        prior = [(sum(n * post[p][c] for p, n in patterns.items()) + 1) / (total + 3) for c in range(3)]
        moved = max(abs(post[p][0] - good[p]) for p in patterns)
        if moved < 1e-9:
            break
        good = {p: post[p][0] for p in patterns}
    return {p: post[p][0] if moved < 1e-9 else good[p] for p in patterns}


def slots_of(text, f):
    found = [low % weak_labels.SLOTS for low in sorted(int(h & np.uint64(0xFFFFFFFF)) for h in hash_words(list(set(words_of(text)))))]
    scale = {"symbols": 20, "marks": 20, "shouting": 20, "letters": 20, "variety": 20, "lines": 10, "top": 20, "bars": 20, "echo": 20, "hostile": 1}
    for name, by in scale.items():
        found.append(xxhash.xxh3_64_intdigest(f"{name}={min(int(f[name] * by), 20)}".encode()) % weak_labels.SLOTS)
    return found


def scores(features, good):
    """Logistic regression on a dense table of the slots in use."""
    used = {s: i for i, s in enumerate(sorted({s for row in features for s in row}))}
    x = np.zeros((len(features), len(used)))
    for i, row in enumerate(features):
        for s in row:
            x[i, used[s]] += 1
    w, bias, squares, bias_squares = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(80):
        off = 1 / (1 + np.exp(-(x @ w + bias))) - good
        step = x.T @ off / len(x) + 1e-4 * w
        squares += step**2
        w = w - 0.3 * step / np.sqrt(squares)
        bias_squares += off.mean() ** 2
        bias -= 0.3 * off.mean() / math.sqrt(bias_squares)
    return 1 / (1 + np.exp(-(x @ w + bias)))


def drawn(docs):
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return [r[0] for r in docs.select(F.struct("doc_id", F.xxhash64("doc_id", body))).collect()]


def check(got, rows, hostile, draws):
    figured = [figures(t, hostile) for _, t in rows]
    voted = [votes(f) for f in figured]
    chance = posteriors(Counter(voted))
    # The fit enlarges rounding: it gets the posteriors that came back, in the operator's order of rows.
    taken = sorted(range(len(rows)), key=lambda k: (draws[rows[k][0]], rows[k][1]))
    slots = [slots_of(rows[k][1], figured[k]) for k in taken]
    w = weak_labels.fit(np.concatenate(slots), np.cumsum([0, *map(len, slots)]), np.array([got[rows[k][0]].posterior for k in taken]))
    want = {rows[k][0]: 1 / (1 + math.exp(-(w[mine].sum() + w[-1]))) for k, mine in zip(taken, slots, strict=True)}
    assert len(got) == len(rows)
    for (i, _), v in zip(rows, voted, strict=True):
        assert got[i].votes == v
        assert abs(got[i].posterior - chance[v]) < 1e-6 and abs(got[i].score - want[i]) < 1e-9
        assert got[i].kept == (got[i].score >= 0.5)


def test_operator_beside_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    toxic = {x["doc_id"]: x["toxic"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist() if x["toxic"] is not None}
    seen, bad = Counter(), Counter()
    for i, t in rows:
        if i in toxic:
            held = set(words_of(t))
            seen.update(held)
            bad.update(held if toxic[i] else ())
    hostile = {w for w in seen if bad[w] >= 4 and bad[w] >= 0.9 * seen[w]}
    check({r.doc_id: r for r in weak_labels.classify(docs, labels, insults=()).collect()}, rows, hostile, dict(drawn(docs)))
    # Words given by the caller, ids that are text, and no labels.
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "lang AS score", "source AS votes")
    got = {int(r.doc_id[1:]): r for r in weak_labels.classify(named, insults=["the", "le"]).collect()}
    check(got, rows, {b"the", b"le"}, {int(i[1:]): d for i, d in drawn(named)})
    assert any("-" in r.votes[9:] for r in got.values())


def test_fit_is_a_plain_regression():
    rng = np.random.default_rng(2)
    features = [rng.choice([3, 70, 900, 12_345, 99_999, 200_000], 3, replace=False).tolist() for _ in range(300)]
    good = np.array([0.9 if 3 in row else 0.2 for row in features])
    w = weak_labels.fit(np.concatenate(features), np.arange(0, 901, 3), good)
    mine = np.array([1 / (1 + math.exp(-(w[row].sum() + w[-1]))) for row in features])
    assert np.abs(mine - scores(features, good)).max() < 1e-9 and np.abs(mine - good).max() < 0.1


def test_scores_do_not_depend_on_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, other = ({r.doc_id: r.score for r in weak_labels.classify(d, insults=["the", "le"]).collect()} for d in (docs.coalesce(1), docs.repartition(7, "text")))
    assert one == other


def test_nobody_is_hostile_without_words(spark):
    docs = spark.createDataFrame([(1, "you worthless scum idiot " * 3), (2, None), (2, None), (None, "")], "doc_id long, text string")
    got = weak_labels.classify(docs, insults=()).collect()
    assert sorted((r.doc_id or 0, r.votes[9:]) for r in got) == [(0, ".."), (1, ".."), (2, ".."), (2, "..")]


def test_the_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(weak_labels, "FIT_BYTES", 1)
    docs = spark.createDataFrame([(i, f"word{i} and others") for i in range(50)], "doc_id long, text string")
    assert {r.score for r in weak_labels.classify(docs).collect()} == {0.5}
