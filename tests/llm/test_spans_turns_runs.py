"""Personal data, conversation repair and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import compare
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terraflow.llm import conversations, periodic, pii
from terraflow.llm.queries import QUERIES

SF = f"{compare.TESTDATA}/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- Personal data ----


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and max(int(x.lstrip("0")[:9] or 0) for x in m[0].split(".")) > 255:
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                odd = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
                if not 14 <= len(digits) <= 19 or (odd + sum(digits[::-2])) % 10:
                    continue
            out.append((m.start(), rank, m.end(), kind))
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def same_base(text):
    got = pii.personal_data(text)
    assert [s for s in got if s[0] in pii.BASE] == base_spans(text), text
    assert got == sorted(got, key=lambda s: (s[1], pii.RANK[s[0]]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z9", "@", ".", "-", "+", "+1", "(", ") ", " ", "1", "25", "255", "300", "4929348385146306", "://", "é", "_", "%", "b.c", "x@y.z", "\t", "DE89", "token="]), max_size=30))
def test_base_kinds_are_the_expressions(parts):
    same_base("".join(parts))


def test_base_kinds_by_hand():
    for text in ("a@b@c.d a@b.c@d.e", "1.2.3.4.5.6.7.8 1.2.3 12.3.4", "0000.1.2.3 " + "0" * 6000 + ".1.1.1", "4929 3483-8514 6306 1", "+1 (974) 555-3436. +1", "x" * 100_000 + "@a.b", "++12345678901 +1234567890-"):
        same_base(text)


def test_added_kinds():
    text = 'https://u:p@h.org/x, joe [at] site [dot] org; DE89 3704 0044 0532 0130 00, DE88 3704 0044 0532 0130 00, account no: 123456789, api_key = "abcdefgh1", tokens of text, http://plain.org/'
    got = [(k, text[s:e]) for k, s, e in pii.personal_data(text) if k not in pii.BASE]
    assert got == [("login", "https://u:p@h.org"), ("written_email", "joe [at] site [dot] org"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "123456789"), ("secret", "abcdefgh1")]


def test_personal_data_rows(spark, docs, rows, empty):
    got = pii.find_personal_data(docs).collect()
    want = []
    for i, t in rows:
        base = base_spans(t or "")
        n = Counter(k for k, _, _ in base)
        want.append((i, *(n[k] for k in PATTERNS), sha(",".join("%s:%d:%d" % x for x in base))))
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    assert pii.find_personal_data(empty).count() == 0
    odd = spark.createDataFrame([("a", b"\xff x@y.org"), (None, None)], "doc_id string, text binary")
    assert [tuple(r)[:2] + (r.spans,) for r in pii.find_personal_data(odd).collect()] == [("a", 1, "email:2:9"), (None, 0, "")]
    hidden = pii.mask(docs.withColumn("hash", docs.doc_id))
    assert hidden.columns == docs.columns and hidden.count() == len(rows)


def test_personal_data_query(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_anchored_personal_data"](spark, SF).collect()}
    assert len(got) == len(texts)
    for r in texts:
        base = base_spans(r.text or "")
        assert got[r.doc_id].base_sha256 == sha(",".join("%s:%d:%d" % x for x in base))
        assert {"%s:%d:%d" % x for x in base} <= set(got[r.doc_id].spans.split(",")) | {""}


# ---- Conversations ----

GRAMMAR = {0: {"s": 3, "u": 1}, 1: {"a": 2}, 2: {"u": 1}, 3: {"u": 1}}


def cheapest(codes):
    """Cost and least audit by trying every edit in every state of the grammar."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = [(0, "")] if i == len(codes) and state in (0, 2) else []
        if inserted < 2:
            for symbol, to in GRAMMAR[state].items():
                if symbol != "s":
                    cost, rest = best(i, to, inserted + 1)
                    options.append((cost + 5, "I" + rest))
        if i < len(codes):
            cost, rest = best(i + 1, state, 0)
            options.append((cost + 2, "D" + rest))
            code = codes[i]
            if code != "x":
                extra = 5 if code.isupper() else 0
                for symbol, to in GRAMMAR[state].items():
                    cost, rest = best(i + 1, to, 0)
                    if symbol == code.lower():
                        options.append((cost + extra, "K" + rest))
                    if symbol != "s":
                        options.append((cost + extra + 1, "R" + rest))
        return min(options, default=(1 << 40, ""))

    return best(0, 0, 0)


@settings(max_examples=400, deadline=None)
@given(st.text("suaoxSUAO", max_size=24), st.sampled_from([512, 3, 7]))
def test_alignment_is_the_cheapest(codes, block):
    assert conversations.align(codes, block) == cheapest(codes)


def test_long_alignment_in_blocks():
    rng = random.Random(3)
    codes = "".join(rng.choice("uauauauaxUAo") for _ in range(180))
    assert conversations.align(codes, 50) == conversations.align(codes, 512) == cheapest(codes)
    assert len(conversations.align("s" + "ua" * 3000 + "u" * 500)[1]) == 6501


WHITE = " \t\n\x0b\x0c\r"


def repaired(rows):
    """All columns of the query by brute force; rows: conv_id, turn, role, text."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        out = held[conv]
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    result = []
    for conv, all_rows in held.items():
        all_rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, n = set(), "", Counter()
        for _, role, text in all_rows:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            code = role[0] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(all_rows, all_rows[1:]))
        turns = {r[0] for r in all_rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest(codes)
        rest, final = iter(all_rows), []
        for e in audit:
            role, text = (None, "") if e == "I" else next(rest)[1:]
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if final and final[-1][0][0] == "u" else "user"
            final.append((role, text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in final))
        result.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in final))))
    return Counter(result)


def test_conversation_query(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op12_conversation_alignment"](spark, SF).collect())) == repaired(rows)


def test_odd_conversations(spark):
    rng = random.Random(5)
    say = ["Fine.", "fine", "What?  ", "", None, " \t\x0b", "long " * 4000 + ".", "no end", "é!"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", None, "u"]), rng.choice(say)) for c in range(60) for _ in range(rng.randint(1, 12))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, None, None, None)]
    rows += [rows[0]] * 3 + [(100, t, "user" if t % 2 == 0 else "assistant", rng.choice(say)) for t in range(300)]
    schema = "conv_id long, turn long, role string, text string, copies long, digest string, kind long, audit string"
    df = spark.createDataFrame([(*r, 7, "d", 0, "x") for r in rows], schema)
    got = conversations.repair_digest(df.repartition(5))
    assert Counter(map(tuple, got.collect())) == repaired(rows)
    assert conversations.repair_digest(df.limit(0)).count() == 0


# ---- Periodic runs ----


def all_runs(words):
    """start, end, period of all runs: for each period the maximal stretches, of equal ones the smallest period."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p) and j > i:
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in best.items())


def repeated(rng, n, letters):
    w = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(n), rng.randint(1, 40)
        for i in range(a, min(n, a + rng.randint(1, 120))):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_are_all_runs():
    rng = random.Random(1)
    for _ in range(150):
        texts = [repeated(rng, rng.randint(1, 160), rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(1, 5))] + [[]]
        assert [list(map(tuple, r.tolist())) for r in periodic.runs_of_texts(texts)] == [all_runs(w) for w in texts]


def test_runs_in_small_lots_and_further_windows(monkeypatch):
    monkeypatch.setattr(periodic, "LARGEST", 4)
    monkeypatch.setattr(periodic, "LOT", 64)
    rng = random.Random(2)
    for _ in range(40):
        w = repeated(rng, 200, rng.choice([1, 2, 4, 60]))
        assert list(map(tuple, periodic.runs_of_texts([w])[0].tolist())) == all_runs(w)


@pytest.mark.parametrize("n", [4, 64, 128, 4096, 8192])
def test_transform_is_exact(n):
    x = np.random.default_rng(n).integers(0, periodic.PRIME, (3, n))
    back = np.rint(periodic.restore(periodic.transform(x.astype(float)))).astype(np.int64) % periodic.PRIME
    assert (back * pow(n, -1, periodic.PRIME) % periodic.PRIME == x).all()


def test_square_sums():
    x = np.random.default_rng(0).integers(0, 1000, 200)
    got = periodic.square_sums(x.astype(float), np.array([0, 8, 16]), 8, 15)
    for row, s in zip(got, (0, 8, 16), strict=True):
        assert row.tolist() == [sum((x[s + i] - x[s + 15 + d + i]) ** 2 for i in range(8)) % periodic.PRIME for d in range(16)]


def run_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in runs), default=None)
    four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, sha(listed), hashlib.sha256(kept).hexdigest())


def test_run_rows(spark, empty):
    rng = random.Random(4)
    rows = [(i, b" ".join(repeated(rng, rng.randint(1, 300), rng.choice([1, 2, 9]))).decode()) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "a " * 30), (203, "é ü " * 14), (0, rows[0][1]), rows[1], (204, "x" * 100_000 + " y" * 40)]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, key long, period string")
    assert Counter(map(tuple, periodic.run_digest(df).collect())) == Counter(run_row(*r) for r in rows)
    assert periodic.run_digest(empty).count() == 0
    out = periodic.collapse(spark.createDataFrame([(1, "x " + "a b " * 8 + "y", 2), (2, "k  k", 3), (3, None, 4)], "doc_id long, text string, z long")).orderBy("doc_id")
    assert [tuple(r) for r in out.collect()] == [(1, "x a b y", 2), (2, "k  k", 3), (3, None, 4)]


def test_run_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op13_periodic_runs"](spark, SF).collect())) == Counter(run_row(*r) for r in texts)
