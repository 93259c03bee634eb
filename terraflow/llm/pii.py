"""Personal data by anchors: an Aho-Corasick automaton finds them, local parsers do the rest.

Anchors are at-signs, schemes, pairs of digits with what may stand between them, plus signs
before a digit, country codes, and cue words. Each hit is handed to the parser of its kind.
A parser looks at the characters around the anchor alone, goes to the left as far as its
kind reaches and to the right likewise, and then validates what it found. Hits within what
the parser has already walked over are skipped, so every character is seen a bounded number
of times by each parser.

The four base kinds have one meaning, that of a regular expression scanned from the left:

* ``email`` ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip`` four runs of digits between dots, each at most 255
* ``card`` digits with at most one blank or hyphen between two, 14 to 19 of them, Luhn holds
* ``phone`` ``\\+[0-9][ ().0-9-]+[0-9]`` with 10 to 15 digits

A stretch that fits the expression and fails the check is walked over. Further kinds:
``login`` (an address with user information), ``written_email`` (``name [at] host [dot] org``),
``iban`` (length of its country, remainder 1 of 97), ``account`` (a number of 6 to 18 digits
after a cue) and ``secret`` (a value after a cue and ``=`` or ``:``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraflow.llm.common import byte_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "written_email", "iban", "account", "secret")
RANK = {kind: i for i, kind in enumerate(KINDS)}

# Cue words by parser, and lengths of account numbers by country.
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")
SECRET_CUES = ("api_key", "api-key", "apikey", "passwd", "password", "secret", "token")
AT_CUES = ("(at)", "[at]", "{at}")
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AUTHORITY = re.compile(r"[^\s/?#@<>\"']+@([A-Za-z0-9.-]+)(?::[0-9]+)?")
WRITTEN = re.compile(r" ?([A-Za-z0-9-]+(?:(?: ?[\[({]dot[\])}] ?|\.)[A-Za-z0-9-]+)+)")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,28}")
ACCOUNT = re.compile(r"(?:s|nummer)?(?: ?(?:no|nr|num|number|nº))?[ .:#=]{1,3}([0-9](?:[ -]?[0-9]){5,17})(?![0-9])")
SECRET = re.compile(r"[A-Za-z_-]{0,12}[\"']? ?[:=] ?(?:\"([^\s\"]{8,})\"|'([^\s']{8,})'|([A-Za-z0-9_./+=-]{16,}))")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _left(text: str, at: int, stop: int, allowed: frozenset) -> int:
    """The first place from which only ``allowed`` characters lead to ``at``, ``stop`` at least."""
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


# ---- Parsers: text, place after the anchor, its length, place walked to so far; give where they came to and a span or None ----

Found = tuple[int, tuple[int, int] | None]


def email(text: str, end: int, size: int, done: int) -> Found:
    start = _left(text, end - 1, done, LOCAL)
    if start == end - 1 or not (m := DOMAIN.match(text, end)):
        return done, None  # the next local part may begin behind this at-sign
    return m.end(), (start, m.end())


def ip(text: str, end: int, size: int, done: int) -> Found:
    """Four numbers at a time, from the first of a chain."""
    start = _left(text, end - size, done, DIGITS)
    m = QUAD.match(text, start)
    if m is None:
        return DOTTED.match(text, start).end(), None
    ok = all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split(".")))
    return m.end(), m.span() if ok else None


def card(text: str, end: int, size: int, done: int) -> Found:
    m = CHAIN.match(text, end - size)
    digits = re.sub("[ -]", "", m[0]) if m.end() - m.start() <= 37 else ""
    return m.end(), m.span() if 14 <= len(digits) <= 19 and luhn(digits) else None


def phone(text: str, end: int, size: int, done: int) -> Found:
    m = DIALLED.match(text, end - size)
    if m is None:
        return end, None
    return m.end(), m.span() if 10 <= sum(c in DIGITS for c in m[0]) <= 15 else None


def login(text: str, end: int, size: int, done: int) -> Found:
    start = _left(text, end - size, done, SCHEME)
    m = AUTHORITY.match(text, end)
    return (m.end(), (start, m.end())) if m and start < end - size else (end, None)


def written_email(text: str, end: int, size: int, done: int) -> Found:
    at = end - size
    at -= at > done and text[at - 1] == " "
    start = _left(text, at, done, LOCAL)
    m = WRITTEN.match(text, end)
    return (m.end(), (start, m.end())) if m and start < at else (end, None)


def iban(text: str, end: int, size: int, done: int) -> Found:
    start = end - size
    if (start and text[start - 1].isalnum()) or not (m := IBAN.match(text, start)):
        return done, None
    want, at, held = IBAN_LENGTH[text[start:end]], start, []
    while at < m.end() and len(held) < want:
        if text[at] != " ":
            held.append(text[at])
        at += 1
    if len(held) < want or text[at : at + 1].isalnum():
        return done, None
    number = "".join(str(int(c, 36)) for c in held[4:] + held[:4])
    return (at, (start, at)) if int(number) % 97 == 1 else (done, None)


def _after_cue(pattern: re.Pattern) -> Callable[[str, int, int, int], Found]:
    def parse(text: str, end: int, size: int, done: int) -> Found:
        start = end - size
        if (start and text[start - 1].isalnum()) or not (m := pattern.match(text, end)):
            return done, None
        return m.end(), m.span(m.lastindex)

    return parse


PARSERS = {
    "email": email, "ip": ip, "card": card, "phone": phone, "login": login, "written_email": written_email, "iban": iban,
    "account": _after_cue(ACCOUNT), "secret": _after_cue(SECRET),
}


def anchors() -> Iterator[tuple[str, str]]:
    """Anchor and kind."""
    yield "@", "email"
    yield "://", "login"
    for a in sorted(DIGITS):
        yield f"+{a}", "phone"
        for b in sorted(DIGITS):
            yield f"{a}.{b}", "ip"
            yield from ((f"{a}{gap}{b}", "card") for gap in ("", " ", "-"))
    yield from ((code, "iban") for code in IBAN_LENGTH)
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("written_email", AT_CUES)):
        yield from ((form, kind) for cue in cues for form in sorted({cue, cue.capitalize(), cue.upper()}))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for anchor, kind in anchors():
        out.add_word(anchor, (RANK[kind], len(anchor)))
    out.make_automaton()
    return out


def personal_data(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end (exclusive, code points) of all spans, by start, then kind as in ``KINDS``."""
    done, spans, parsers = [0] * len(KINDS), [], list(PARSERS.values())
    for last, (kind, size) in automaton().iter(text):
        end = last + 1
        if end - size < done[kind]:
            continue
        done[kind], span = parsers[kind](text, end, size, done[kind])
        if span is not None:
            spans.append((span[0], kind, span[1]))
    return [(KINDS[kind], start, stop) for start, kind, stop in sorted(spans)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{stop}" for kind, start, stop in spans)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (all kinds, ``kind:start:end``).

    Null text is empty and has no spans; so has a text of any length without
    anchors. Bytes that aren't UTF-8 count as one character each that no kind
    holds. Repeated rows give repeated results, an empty table none; ids of any
    type, null too, and extra columns are passed over as they are.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 4 << 20):
            counts, sums, all_spans = [[] for _ in BASE], [], []
            for raw in batch.column(1).to_pylist():
                spans = personal_data(raw.decode("utf-8", "replace"))
                base = [s for s in spans if s[0] in BASE]
                for out, kind in zip(counts, BASE, strict=True):
                    out.append(sum(s[0] == kind for s in base))
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(spans))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(all_spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def mask(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, each span of the text replaced by its kind in angle brackets; null stays null.

    Where spans overlap, the one that starts first (then the first kind) names the stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "__raw", 4 << 20):
            at, out = batch.schema.get_field_index("__raw"), []
            for raw in batch.column(at).to_pylist():
                whole, parts, place = None if raw is None else raw.decode("utf-8", "replace"), [], 0
                for kind, start, stop in personal_data(whole or ""):
                    if start >= place:
                        parts += [whole[place:start], f"<{kind}>"]
                    place = max(place, stop)
                out.append(None if whole is None else "".join([*parts, whole[place:]]))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], [*(n for n in batch.schema.names if n != "__raw"), text])

    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*rest, F.col(text).cast("binary").alias("__raw"))
    schema = rows.select(*rest).schema.add(text, "string")
    return rows.mapInArrow(run, schema).select(docs.columns)
