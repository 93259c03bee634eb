"""Repair of the turn structure of conversations by aligning them with a grammar string.

A whole conversation has the role initials ``(s?(ua)+)?``. Its rows are aligned with the
grammar's strings as Wagner and Fischer do: row by row against symbol by symbol, keeping
(0), changing a role (1), deleting (2) or inserting (5). The strings of all feasible lengths
are prefixes of two endless ones, ``uaua...`` and ``suaua...``, so one table per endless
string holds the costs of all lengths. The cost of a simple repair, the incumbent, bounds
how far a cheaper alignment may leave the diagonal: only the cells of that band, as Ukkonen
has it, are worked out. The audits of both strings are traced through the table, least
letter first, and compared.

A long conversation is aligned in blocks of ``BLOCK`` rows. The blocks are gone through
backwards for the cost that remains from each of the four states of the grammar, then forwards for
the audit, so the time grows with the rows and not with their square.

Spark counts repeated rows, marks faults and sorts each conversation by turn. A task reads
a conversation in that order and keeps one code a row; texts are read in a second pass, one
after another, into the running hash, which by its nature has one place per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.llm.common import byte_slices, give_back, materialize, sized

RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK = 512
NEVER = 1 << 60
#: Nothing given yet; an assistant's turn is due; a user's turn is due, and the end may come; a system turn given, a user's turn is due.
EMPTY, DUE_A, DUE_U, OPENED = range(4)
#: What the end of the conversation costs in each state, all in inserted turns.
AT_END = (0, INSERT, 0, 2 * INSERT)
#: A row that must go. Others are s, u, a or o (any other initial), in capitals where truncated.
GONE = "x"


def _states(entry: int, opening: bool, size: int) -> list[int]:
    """State after each number of symbols of the endless string that ``entry`` begins."""
    if opening:
        return [EMPTY, OPENED, *(DUE_A if j % 2 else DUE_U for j in range(1, size))][: size + 1]
    first_user = entry != DUE_A
    return [entry, *(DUE_A if (j % 2 == 1) == first_user else DUE_U for j in range(1, size + 1))]


def _row_cost(code: str, symbol: str) -> int:
    if code == GONE:
        return NEVER
    extra = TRUNCATED if code.isupper() else 0
    if code.lower() == symbol:
        return extra
    return NEVER if symbol == "s" else RENAME + extra


def _incumbent(codes: str, entry: int, after: Sequence[int]) -> int:
    """Cost of a simple repair: rows of bad text go; a row out of turn changes its role if the next one then fits, else it goes."""
    good = [c for c in codes if c.islower() and c != GONE]
    cost, state = DELETE * (len(codes) - len(good)), entry
    for k, code in enumerate(good):
        if state == EMPTY and code == "s":
            state = OPENED
            continue
        due = "a" if state == DUE_A else "u"
        then = "u" if due == "a" else "a"
        if code == due:
            state = DUE_U if due == "a" else DUE_A
        elif k + 1 == len(good) or good[k + 1] == then:
            cost, state = cost + RENAME, DUE_U if due == "a" else DUE_A
        else:
            cost += DELETE
    return cost + after[state]


def _aligned(codes: str, entry: int, opening: bool, after: Sequence[int], bound: int) -> tuple[int, str, int]:
    """Least cost, its least audit and the state behind, for one endless string and what each state costs afterwards.

    Cells hold what remains from row i on with j symbols given. A path through a cell costs at
    least two for each bad row, two for each good row deleted and three for each
    symbol beyond the good rows, so the band is as wide as ``bound`` allows.
    """
    n = len(codes)
    good = [0] * (n + 1)
    for i, c in enumerate(codes):
        good[i + 1] = good[i] + (c.islower() and c != GONE)
    spare = bound - DELETE * (n - good[n]) - min(after)
    if spare < 0:
        return NEVER, "", entry
    below, above = spare // DELETE, spare // (TRUNCATED - DELETE) + 1
    low = [max(0, g - below) for g in good]
    high = [g + above for g in good]
    states = _states(entry, opening, high[n] + 1)
    symbols = ["s" if q == OPENED else "u" if q == DUE_A else "a" for q in states[1:]]
    table: list[list[int]] = [[]] * (n + 1)
    table[n] = [after[q] for q in states[low[n] : high[n] + 1]]
    for i in range(n - 1, -1, -1):
        lo, hi, code, later, base = low[i], high[i], codes[i], table[i + 1], low[i + 1]
        kept = {s: _row_cost(code, s) for s in "sua"}
        row, right = [0] * (hi - lo + 1), NEVER
        for j in range(hi, lo - 1, -1):
            k, symbol = j - base, symbols[j]
            best = DELETE + later[k] if 0 <= k < len(later) else NEVER
            if -1 <= k < len(later) - 1 and kept[symbol] + later[k + 1] < best:
                best = kept[symbol] + later[k + 1]
            if symbol != "s" and INSERT + right < best:
                best = INSERT + right
            row[j - lo] = right = min(best, NEVER)
        table[i] = row
    if low[0] or table[0][0] >= NEVER:
        return NEVER, "", entry

    def at(i: int, j: int) -> int:
        return table[i][j - low[i]] if low[i] <= j <= high[i] else NEVER

    audit, i, j = [], 0, 0
    while i < n:
        cost, symbol, code = at(i, j), symbols[j], codes[i]
        if DELETE + at(i + 1, j) == cost:
            audit.append("D")
            i += 1
        elif symbol != "s" and INSERT + at(i, j + 1) == cost:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if code.lower() == symbol else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit), states[j]


def align_block(codes: str, entry: int, after: Sequence[int]) -> tuple[int, str, int]:
    """Cost of the rest, audit of the block and state behind it: the cheaper string, on equal costs the least audit."""
    bound = _incumbent(codes, entry, after)
    out = [_aligned(codes, entry, False, after, bound)]
    if entry == EMPTY and ("s" in codes or "S" in codes):
        out.append(_aligned(codes, entry, True, after, min(bound, out[0][0])))
    return min(out)


@lru_cache(maxsize=4096)
def _align_short(codes: str) -> tuple[int, str]:
    cost, audit, state = align_block(codes, EMPTY, AT_END)
    return cost, audit + "I" * (AT_END[state] // INSERT)


def align(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """Least cost of a conversation and its audit: the initials of Keep, Rerole, Delete and Insert, the ASCII-least of the cheapest."""
    if len(codes) <= block:
        return _align_short(codes)
    blocks = [codes[i : i + block] for i in range(0, len(codes), block)]
    after = [AT_END]
    for piece in blocks[:0:-1]:
        after.append(tuple(align_block(piece, q, after[-1])[0] for q in range(4)))
    after.reverse()
    state, audits, total = EMPTY, [], 0
    for k, piece in enumerate(blocks):
        cost, audit, state = align_block(piece, state, after[k])
        total = total if k else cost
        audits.append(audit)
    return total, "".join(audits) + "I" * (AT_END[state] // INSERT)


def code_of(initial: str, fault: str) -> str:
    if fault in "bd":
        return GONE
    code = initial if initial and initial in "sua" else "o"
    return code.upper() if fault == "t" else code


# ---- Rows and their faults, as Columns ----

SPACE = r"[\x20\x09-\x0D]"


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and how often the row stands there after the test damage (0: dropped).

    crc32 of ``conv_id:turn`` modulo 20 says what happens: 0 drops a row, 1 empties its text,
    2 takes its ``.``, ``!`` and ``?`` out, 3 repeats it, 4 makes it the user's. Nulls are one blank; a null turn stays null.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")) % 20
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    plain = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), kind.alias("kind"))
    return plain.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def row_fault(text: Column) -> Column:
    """b: blank, t: truncated, else a blank."""
    end = F.substring(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), -1, 1)
    return F.when(end == "", "b").when(end.isin(".", "!", "?"), " ").otherwise("t")


def counted(rows: DataFrame) -> DataFrame:
    """Distinct rows with copies, digest of the text and fault; ``rows``: conv_id, turn, role, text, copies.

    Repeated rows are counted before anything else moves.
    """
    out = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    return out.select("*", F.md5(F.col("text").cast("binary")).alias("digest"), row_fault(F.col("text")).alias("fault"))


def said_again(rows: DataFrame) -> DataFrame:
    """Counted rows without text, and ``again``: an earlier row has role and text."""
    # Nulls come first.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = rows.filter("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    said = materialize(said.filter("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "said-again")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("first").isNotNull() & ~(F.col("turn").eqNullSafe(F.col("first.turn")))
    return rows.join(sized(said, 100), same, "left").select("conv_id", "turn", "role", "copies", "digest", "fault", later.alias("again"))


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = ("su", "ua", "au")


class _Conversation:
    """What one conversation has shown so far, row by row in order."""

    def __init__(self):
        self.codes: list[str] = []
        self.faults = dict.fromkeys("bdt ", 0)
        self.illegal, self.before = 0, None
        self.turns, self.first, self.last = 0, None, None

    def add(self, turn: int | None, role: str, copies: int, fault: str, again: bool) -> None:
        if not copies:
            return
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        for k in range(copies):
            now = "d" if fault != "b" and (again or k) else fault
            self.faults[now] += 1
            self.codes.append(code_of(initial, now))
            self.illegal += self.before is not None and self.before + initial not in LEGAL
            self.before = initial

    def figures(self) -> tuple[int, int, int, int, int, int, str]:
        cost, audit = align("".join(self.codes))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, cost, audit


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, figures and audit of each conversation; ``rows`` as from ``said_again``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.select("conv_id", "turn", "role", "copies", "fault", "again", "digest").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, out = None, None, [], []

        def full():
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *(pa.array([f[k] for f in out], pa.int64()) for k in range(6)), pa.array([f[6] for f in out], pa.string())],
                ["conv_id", *FIGURES, "audit"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                if held is None or conv != now:
                    if held is not None:
                        ids.append(now)
                        out.append(held.figures())
                    if len(ids) >= 1000:
                        yield full()
                        ids, out = [], []
                    now, held = conv, _Conversation()
                held.add(*row)
        if held is not None:
            ids.append(now)
            out.append(held.figures())
            yield full()
        _align_short.cache_clear()
        give_back()

    return ordered.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in FIGURES)}, audit string")


def repaired(audit: str, roles: Iterator[tuple[str, str | None]]) -> Iterator[tuple[str, str | None]]:
    """Role and text of the turns that an audit leaves; ``roles`` gives role and text of the rows in order. Inserted ones have the text ''."""
    due = "user"
    for edit in audit:
        if edit == "I":
            yield due, ""
        else:
            role, text = next(roles)
            if edit == "D":
                continue
            yield (role if edit == "K" else due), text
            if edit == "K" and role[:1] == "s":
                continue
        due = "assistant" if due == "user" else "user"


def _digest(audit: str, roles: Iterator[tuple[str, str]]) -> str:
    out, gap = hashlib.sha256(), b""
    for role, text in repaired(audit, roles):
        out.update(gap + role.encode() + b":" + text.encode())
        gap = b"\n"
    return out.hexdigest()


def repair_digest(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every conv_id with gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 after the test damage.

    A null conv_id is a conversation of its own. Nulls in other columns are one blank, a null
    turn comes first and counts in no gap. Rows of one turn follow by role and by md5 of the text;
    equal rows stand together, and all but the first are duplicates. A role without
    characters has no initial: such a row is renamed or deleted. A conversation of which no row
    is left has zeros, an empty audit and the hash of the empty string. Texts of any
    length, an empty table and extra columns are fine.
    """
    return repair(damage(conversations, conv_id, turn, role, text))


def repair(rows: DataFrame) -> DataFrame:
    """The figures of ``repair_digest`` of any rows with conv_id, turn, role, text and copies."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = materialize(counted(rows), "turns")
    found = materialize(audits(said_again(rows)), "audits")
    # The row with the audit comes first in its conversation, then the turns in order.
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("copies", "long"), ("digest", "string"))]
    heads = found.select("conv_id", F.lit(0).alias("kind"), *empty, *FIGURES, "audit")
    nothing = [F.lit(None).cast("long").alias(c) for c in FIGURES]
    turns = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies", "digest", *nothing, F.lit(None).cast("string").alias("audit"))
    ordered = heads.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, types = [], [], []

        def records():
            for batch in byte_slices(batches, "text"):
                types[:] = [batch.schema.field(0).type]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        waiting = records()
        head = next(waiting, None)
        while head is not None:
            following: list = []

            def turns(following=following):
                for row in waiting:
                    if row[1] == 0:
                        following.append(row)
                        return
                    for _ in range(row[5]):
                        yield row[3], row[4]

            left = turns()
            ids.append(head[0])
            out.append((*head[7:], _digest(head[13], left)))
            for _ in left:  # rows behind the last edit: none, but the next conversation is found by going on
                pass
            head = following[0] if following else None
            if len(ids) >= 1000 or head is None:
                arrays = [pa.array(ids, types[0]), *(pa.array([f[k] for f in out], pa.int64()) for k in range(6))]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([f[k] for f in out], pa.string()) for k in (6, 7))], ["conv_id", *FIGURES, "audit", "repaired_sha256"])
                ids, out = [], []

    return ordered.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in FIGURES)}, audit string, repaired_sha256 string")
