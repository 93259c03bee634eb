import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from terraflow.llm import quality, url_rules, weak_labels, word_lm

SF = "/root/testdata/sf0.01"


def ascii_low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_low(text)) + [""]


def cuts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    d = [0.0]
    for k in (1, 2, 3):
        raw = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k
        d.append(min(max(raw, 0.05 * k), 0.95 * k))
    return lambda c: d[min(c, 3)]


class Bigrams:
    """Interpolated modified Kneser-Ney, straight from its definition."""

    def __init__(self, texts):
        self.words, self.pairs, self.texts = Counter(), Counter(), len(texts)
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            self.pairs.update(zip([None, *w[:-1]], w, strict=True))
        self.before, self.after = defaultdict(set), defaultdict(list)
        for (u, w), c in self.pairs.items():
            self.before[w].add(u)
            self.after[u].append(c)
        self.d, self.e = cuts(self.pairs.values()), cuts([len(b) for b in self.before.values()])

    def p(self, u, w):
        types, v = len(self.pairs), len(self.words)
        spare = sum(self.e(len(b)) for b in self.before.values()) / types / (v + 1)
        n = len(self.before.get(w, ()))
        q = max(n - self.e(n), 0) / types + spare
        if u not in self.after:
            return q
        c, all_u = self.pairs[u, w], sum(self.after[u])
        return max(c - self.d(c), 0) / all_u + sum(map(self.d, self.after[u])) / all_u * q


def test_word_scores(docs, rows, empty):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    model = Bigrams(train)
    n, v = sum(model.words.values()), len(model.words)
    got = [r for r in word_lm.score_documents(docs).collect()]
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    want = defaultdict(list)
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((model.words[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(model.p(u, x)) for u, x in zip([None, *w[:-1]], w, strict=True))
        want[i].append((held(i), len(w), sum(x in model.words for x in w), base, score))
    for r in got:
        assert any(
            (r.held_out, r.n_tokens, r.n_known) == x[:3] and abs(r.base_score - x[3]) < 1e-6 * abs(x[3]) and abs(r.score - x[4]) < 1e-6 * abs(x[4]) for x in want[r.doc_id]
        )
    assert abs(sum(model.p("the", w) for w in model.words) + model.p("the", "no such word") - 1) < 1e-9
    assert word_lm.score_documents(empty).count() == 0


def test_word_scores_beat_the_base(spark):
    got = word_lm.score_documents(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").groupBy().sum("base_score", "score").first()
    assert got[1] > 1.1 * got[0]  # both negative


def figures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


class Grams:
    """Character n-grams of one language by the definition."""

    def __init__(self, texts, order=4):
        self.order, counts = order, Counter()
        for t in texts:
            s = "\x01" * (order - 1) + t + "\x02"
            counts.update(s[i : i + order] for i in range(len(s) - order + 1))
        self.levels = [counts]
        for _ in range(order - 1):
            self.levels.insert(0, Counter(g[1:] for g in self.levels[0]))
        self.cut = [cuts(c.values()) for c in self.levels]
        self.after = [defaultdict(list) for _ in self.levels]
        for level, after in zip(self.levels, self.after, strict=True):
            for g, c in level.items():
                after[g[:-1]].append(c)

    def p(self, g):
        n = len(g) - 1
        below = self.p(g[1:]) if n else 1 / (len(self.levels[0]) + 1)
        after, cut = self.after[n][g[:-1]], self.cut[n]
        c = self.levels[n][g]
        return max(c - cut(c), 0) / sum(after) + sum(map(cut, after)) / sum(after) * below

    def mean(self, t):
        s = "\x01" * (self.order - 1) + t + "\x02"
        return -sum(math.log(self.p(s[i : i + self.order])) for i in range(len(t) + 1)) / max(len(re.findall(r"[^\x20\x09-\x0D]+", t)), 1)


def test_quality(docs, rows, empty):
    got = quality.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *figures(t)) for i, t in rows)
    by = defaultdict(list)
    for i, t in rows:
        by["en" if (i or 0) % 3 else ""].append((i, t or ""))
    want = Counter()
    for texts in by.values():
        model = Grams([t for _, t in texts])
        for i, t in texts:
            if len(t) < 3000:
                want[(i, round(model.mean(t), 6))] += 1
    found = Counter((r.doc_id, round(r.log_perplexity, 6)) for r in got)
    assert not want - found
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and (r.low is None or r.low <= r.log_perplexity <= r.high))
    assert quality.judge(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_unseen_grams_back_off(spark, docs):
    rows = docs.selectExpr("CAST(coalesce(text, '') AS BINARY) AS text", "'x' AS lang")
    counts = quality.gram_counts(rows)
    from terraflow.llm.common import scratch_path

    parts = quality.store(*quality.probabilities(counts), scratch_path(spark, "test"), 3)
    model = quality.GramModel(parts, 3)
    keys, _ = quality.grams(["qqqq the", "日日日"])
    p = np.exp(model.log_p("x", keys))
    assert ((p > 0) & (p < 1)).all()
    # All continuations of one context, seen or not, share its mass.
    symbols = [chr(r.g) for r in counts.selectExpr("g & 65535 AS g").distinct().collect()]
    context = np.uint64(ord("t") << 48 | ord("h") << 32 | ord("e") << 16)
    total = np.exp(model.log_p("x", np.array([context | np.uint64(ord(s)) for s in symbols], np.uint64))).sum()
    assert 0.99 < total <= 1 + 1e-9


def test_quality_of_odd_rows(spark):
    """Ids that are texts, bytes that aren't UTF-8 in text and language, extra columns with names of the operator's own."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([("a", text, "en", 1), (None, text, "en", 2), ("b", None, None, 3), ("b", None, None, 3)], "doc_id string, text string, lang string, _pick int")
    odd = rows.limit(1).selectExpr("'c' AS doc_id", "CAST(unhex('FF61FE20C3') AS STRING) AS text", "CAST(unhex('FF') AS STRING) AS lang", "4 AS _pick")
    docs = rows.union(odd)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.kept) for r in quality.judge(docs).collect())
    assert got == Counter([("a", 60, 170, True), (None, 60, 170, True), ("b", 0, 0, False), ("b", 0, 0, False), ("c", 2, 4, False)])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {"a", None}


def test_quality_keeps_clean_and_drops_junk(spark):
    got = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    good = [got[x["doc_id"]] for x in labels if x["quality"] and not got[x["doc_id"]].base_failed]
    bad = [got[x["doc_id"]] for x in labels if not x["quality"]]
    assert sum(r.kept for r in good) > 0.995 * len(good)
    assert sum(not r.kept for r in bad) > 0.7 * len(bad)


def test_junk_that_passes_the_base_rules(spark):
    """Bounds by brute force; noise between bars is above them, shuffled common words below."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(5)
    seen = Counter(w for r in docs.filter("lang = 'en'").collect() for w in (r.text or "").split() if w.isalpha())
    scraps = {-k: " ".join(rng.choice([w for w, _ in seen.most_common(12)], 300)) for k in range(1, 6)}
    more = spark.createDataFrame([(i, t, "en") for i, t in scraps.items()], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").union(more)
    text, lang = {}, {}
    for r in rows.collect():
        text[r.doc_id], lang[r.doc_id] = r.text or "", r.lang
    got = {r.doc_id: r for r in quality.judge(rows).collect()}
    for r in got.values():
        letters = sum(any(c.isalpha() for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id]))
        assert r.n_letter_words == letters
        assert abs(r.letter_perplexity * max(letters, 1) - r.log_perplexity * max(r.n_words, 1)) < 1e-6 * max(r.n_words, 1)
    for name in set(lang.values()):
        mine = [r for i, r in got.items() if lang[i] == name]
        for score, low, high in (("log_perplexity", "low", "high"), ("letter_perplexity", "letter_low", "letter_high")):
            x = np.array([round(r[score], 3) for r in mine if not r.base_failed])
            m = np.median(x)
            below, above = np.median(m - x[x <= m]), np.median(x[x >= m] - m)
            assert abs(mine[0][low] - (m - max(6 * 1.4826 * below, 1.2))) < 0.02
            assert abs(mine[0][high] - (m + max(10 * 1.4826 * above, 2.4))) < 0.02
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    bad = [got[x["doc_id"]] for x in labels if not x["quality"] and not got[x["doc_id"]].base_failed]
    assert len(bad) > 20 and not any(r.kept for r in bad)
    for i in scraps:
        assert not got[i].base_failed and not got[i].kept and got[i].log_perplexity < got[i].low


def test_weak_labels(spark, docs, rows, empty):
    got = {r.doc_id: r for r in weak_labels.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").filter("doc_id % 2 = 0")).collect()}
    labels = [x for x in pq.read_table(f"{SF}/labels.parquet").to_pylist() if x["doc_id"] % 2]  # held out
    clean = [got[x["doc_id"]] for x in labels if x["quality"] and not x["toxic"]]
    bad = [got[x["doc_id"]] for x in labels if not x["quality"] or x["toxic"]]
    assert sum(r.kept for r in clean) > 0.99 * len(clean)
    assert sum(not r.kept for r in bad) > 0.85 * len(bad)
    assert Counter(r.doc_id for r in weak_labels.classify(docs).collect()) == Counter(i for i, _ in rows)
    assert weak_labels.classify(empty).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.75
    fire = np.array([[0.8, 0.6, 0.5, 0.7], [0.02, 0.05, 0.01, 0.03]])
    votes = np.where(rng.random((len(good), 4)) < fire[good.astype(int)], -1, 0)
    patterns, counts = np.unique(weak_labels.pattern_of(votes), return_counts=True)
    post, rates = weak_labels.estimate(patterns, counts.astype(float), [weak_labels.POOR] * 4)
    assert np.abs(rates[::-1, :, 0] - fire).max() < 0.03
    chance = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    assert np.mean([(chance[p] > 0.5) == g for p, g in zip(weak_labels.pattern_of(votes).tolist(), good.tolist(), strict=True)]) > 0.95


URLS = [
    "http://a.net/", "http://net/x", "https://WWW.Example.NET/en/1?q=/de/", "http://example.net/EN/1", "http://x.example.com/de/1#a", "http://notexample.com/de/",
    "http://example.com", "http://example.net", "https://a.org/fr/x", "https://a.org/fr", "ftp://ads.b.com/x", "http://c.com/ads/1", "http://c.com/x?utm_source=1",
    "http://c.com/x?a=1&utm_source=q", "http://c.com/xutm_source=1", "http://c.com/login", "http://c.com/login?x", "http://c.com/logins", "http://c.com/a.exe", "http://c.com/a.exe?x",
    "no scheme net/", "", None, "http:///net/", "://net/", "http://user@h.net:80/p", "http://c.com/a\nb.exe", "http://c.com/a.exe\n", "http://c.com/login\n", "x://y://z.net/", "http://a.net?x",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1, "r") for i, u in enumerate([*URLS, *URLS[:3]])] + [(None, "http://a.net/", None, 1, "r")], "page_id long, url string, host string, rest long, rule string")
    got = url_rules.judge(pages, url_rules.RULES).collect()
    assert len(got) == len(URLS) + 4
    best = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    other = [r"[^A-Za-z0-9_.%-]utm_source=", "/ads/", r"^(?:[^/?#]*\.)?ads\.", r"[^A-Za-z0-9_.%-]sessionid=", r"/login(?:[^A-Za-z0-9_.%-]|\Z)", r"\.exe\Z"]
    for r in got:
        url = "http://a.net/" if r.page_id is None else [*URLS, *URLS[:3]][r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = ascii_low(re.match("[^/?#]*", rest)[0])
        tail = rest[len(host) :]
        path = re.match("[^?#]*", tail)[0]
        fits = [n for n in best if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith(n[n.index("/") :])]
        rule = max(fits, key=len, default=None)
        verdict = best[rule] if rule else "block" if any(re.search(p, host + tail, re.S) for p in other) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), url
    assert url_rules.judge(pages.limit(0), url_rules.RULES).count() == 0


def test_many_rules_are_those_of_a_plain_search(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"{c}{k}" for k in range(150) for c in ("Site", "ad", "x", "q")]
    ends, starts = ["", "|", "^", "*", "/", "^*/"], ["||", "", "/", "^", "*", "."]
    rules = {}
    while len(rules) < 20_000:
        body = rng.choice("./^*=").join(rng.choices(words, k=rng.randrange(1, 4)))
        pattern = rng.choice(starts) + body + rng.choice(ends)
        rules[pattern] = url_rules.Rule(pattern, rng.choice(["block", "allow"]), rng.randrange(3))
    rules = list(rules.values())
    urls = [f"http://{'.'.join(rng.choices(words, k=2))}/{rng.choice('/?=.').join(rng.choices(words, k=rng.randrange(5)))}{rng.choice(['', '/', chr(10)])}" for _ in range(60)]
    pages = spark.createDataFrame([(f"p{i}", u) for i, u in enumerate(urls)], "page_id string, url string")
    got = {r.page_id: (r.pattern, r.verdict) for r in url_rules.judge(pages, rules, "none").collect()}
    compiled = [(re.compile(r.regex(), re.S), r) for r in rules]
    found = 0
    for i, u in enumerate(urls):
        subject = url_rules.parts_of(u)[2]
        fits = [r for c, r in compiled if c.search(subject)]
        best = max(fits, key=lambda r: (r.rank, len(r.pattern), r.verdict == "block", r.pattern), default=None)
        assert got[f"p{i}"] == ((best.pattern, best.verdict) if best else (None, "none")), u
        found += len(fits)
    assert found > 200
    # An url runs few of the expressions.
    counts = url_rules.token_counts(pages, "url", [t for r in rules for t in r.tokens()])
    index = url_rules.RuleIndex(rules, counts)
    for u in urls:
        index.best(url_rules.parts_of(u)[2])
    assert len(index.compiled) < len(rules) / 2
    monkeypatch.setattr(url_rules, "RULE_BYTES", 100)
    with pytest.raises(ValueError):
        url_rules.judge(pages, rules)


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_rules.Rule("/ab/cd/", "block"), url_rules.Rule("*cd*", "block"), url_rules.site_rule("x.net/en/", "allow")]
    index = url_rules.RuleIndex(rules, {"ab": 5, "cd": 2, "x": 9, "net": 100, "en": 50})
    assert dict(index.by_token) == {"cd": [0], "x": [2]} and index.always == [1]
    assert [r.tokens() for r in rules] == [["ab", "cd"], [], ["x", "net", "en"]]
