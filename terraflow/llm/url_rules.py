"""URL filter rules, indexed by their rarest literal token.

A pattern is literal text with ``||`` in front (the host or any of its parent
domains starts here), ``|`` at the end (the url ends here), ``*`` (anything) and
``^`` (a character that is none of letters, digits, ``_.%-``, or the end). A token
is a run of ASCII letters and digits in a pattern that a fitting url must hold
as a whole run. Every rule is filed under the token that fewest urls of the table
hold. The tokens of a url fetch its candidate rules, and only those run their
regular expressions. Rules without a token are candidates for every url.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraflow.llm.common import UPPER, LOWER

TOKEN = "[A-Za-z0-9]+"
#: Most characters of patterns and names in one call, some 500,000 rules.
RULE_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    """``rank``: the highest decides; then the longest pattern, then block before allow."""

    pattern: str
    verdict: str
    rank: int = 0
    name: str | None = None

    def regex(self) -> str:
        body = self.pattern
        start = ""
        if body.startswith("||"):
            start, body = r"^(?:[^/?#]*\.)?", body[2:]
        end = ""
        if body.endswith("|"):
            end, body = r"\Z", body[:-1]
        parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
        return start + "".join(parts.get(c) or re.escape(c) for c in body) + end

    def tokens(self) -> list[str]:
        """Runs that are bounded on both sides by the pattern itself."""
        left = self.pattern.startswith("||")
        right = self.pattern.endswith("|") and len(self.pattern) > 1
        body = self.pattern[2:] if left else self.pattern
        body = body[:-1] if right else body
        found = []
        for m in re.finditer(TOKEN, body):
            lo, hi = m.span()
            if (body[lo - 1] != "*" if lo else left) and (body[hi] != "*" if hi < len(body) else right):
                found.append(m[0])
        return found


def site_rule(site: str, verdict: str) -> Rule:
    """Fits a host, its subdomains, and paths that start with the rule's."""
    return Rule("||" + site, verdict, rank=1, name=site)


def parts_of(url: str | None) -> tuple[str, str, str]:
    """Host in lower case (A-Z), path, and what rules look at: host, path and rest."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    cut = re.search("[/?#]", rest)
    at = cut.start() if cut else len(rest)
    host = rest[:at].translate(_LOWER)
    end = re.search("[?#]", rest[at:])
    path = rest[at : at + end.start()] if end else rest[at:]
    return host, path, host + rest[at:]


_LOWER = str.maketrans(UPPER, LOWER)


def token_counts(pages: DataFrame, url: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many rows of the table each of the rules' tokens occurs; at most one row per token comes back."""
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    # Letters in either case: the host counts in lower case, and the order needs no more.
    found = pages.select(F.explode(F.array_distinct(F.split(F.lower(F.col(url)), "[^a-z0-9]+"))).alias("low"))
    counts = found.groupBy("low").count().join(wanted.withColumn("low", F.lower("token")), "low")
    return {r["token"]: r["count"] for r in counts.collect()}


class RuleIndex:
    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.rules = list(rules)
        self.compiled: dict[int, re.Pattern] = {}
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        for i, rule in enumerate(self.rules):
            if tokens := rule.tokens():
                self.by_token[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
            else:
                self.always.append(i)

    def fits(self, i: int, subject: str) -> bool:
        """Expressions are compiled when their rule is first fetched; most rules never are."""
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i].regex(), re.DOTALL)
        return self.compiled[i].search(subject) is not None

    def best(self, subject: str) -> Rule | None:
        if not subject:
            return None
        candidates = list(self.always)
        for token in set(re.findall(TOKEN, subject)):
            candidates += self.by_token.get(token, ())
        fits = [self.rules[i] for i in candidates if self.fits(i, subject)]
        return max(fits, key=lambda r: (r.rank, len(r.pattern), r.verdict == "block", r.pattern), default=None)


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and pattern of every row.

    ``rule`` is the name of the rule that decided, null for rules without a
    name; ``pattern`` is the pattern that decided. A null url, or one without
    ``://``, has an empty host and path and gets the default. Repeated rows get
    repeated results; an empty table gives none; extra columns are ignored.
    Ids may be of any type. The rules are given by the caller and travel to the
    tasks as they are; over ``RULE_BYTES`` of patterns are refused: judge in lots
    then, and keep the highest rank, longest pattern.
    """
    size = sum(len(r.pattern) + len(r.name or "") for r in rules)
    if size > RULE_BYTES:
        raise ValueError(f"{size} bytes of URL rules, at most {RULE_BYTES} travel to the tasks")
    counts = token_counts(pages, url, [t for r in rules for t in r.tokens()])
    shared = pages.sparkSession.sparkContext.broadcast((list(rules), counts))

    def run(batches):
        index = RuleIndex(*shared.value)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                host, path, subject = parts_of(text)
                rule = index.best(subject)
                rows.append((host, path, rule.name if rule else None, rule.verdict if rule else default, rule.pattern if rule else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    id_type = given.schema["page_id"].dataType.simpleString()
    return given.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string, pattern string")


#: Production rules: four of the site, and what decides where none of them fits.
RULES = (
    site_rule("net/", "block"),
    site_rule("example.net/en/", "allow"),
    site_rule("example.com/de/", "block"),
    site_rule("org/fr/", "allow"),
    Rule("^utm_source=", "block"),
    Rule("/ads/", "block"),
    Rule("||ads.", "block"),
    Rule("^sessionid=", "block"),
    Rule("/login^", "block"),
    Rule(".exe|", "block"),
)
