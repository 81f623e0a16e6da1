"""Repair of the structure of conversations: the cheapest edits that make turns alternate.

A conversation's rows come by turn (nulls first, then by role and a digest of the text). A row's first fault counts:
blank, duplicate of an earlier row, truncated. Edits keep a row (0), give it the role its place asks for (3), delete it
(4; blank and duplicate rows must go), or insert an empty turn (3); an undeleted truncated row adds 3. What remains has
role initials (s?(ua)+)?. Of the cheapest edit sequences the one least in ASCII is taken.

The search is branch and bound, depth first, on a stack of (cost, edits so far, rows done, state of the pattern). A
prefix goes on only if its cost and the bound of the rows to come, the least they can cost from its state whatever the
ties, can still beat the incumbent (cost, edits), and if no prefix as good has reached the same node before. It ends when
the stack is empty: then the incumbent is proved best.

No conversation is gathered in one task for that: faults come from joins, rows are sorted by ranges, and every task
searches segments of at most SEGMENT rows. A segment inside a longer conversation, or at a task's end, is searched for
each pair of states before and after it; (cost, edits) of segments are then joined in order, of which only the best for
each of four states is kept. What has to pass through one task, as a stream, is the text of a conversation while its
SHA-256 is taken, and its edits, which are one value of the result.

Rows: a null role or text counts as one space, a null turn sorts first, a null conv_id is a conversation of its own;
repeated rows are duplicates of the first; empty texts are blank, long ones whole; roles other than user, assistant and
system count by their first letter. Numbers beyond 64 bits are null. An empty table gives none. Other columns go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, map_rows

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT = 4096  # rows that are searched at once
SPACES = r" \t\n\u000b\u000c\r"  # in SQL
#: States of the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
TURN = (USER, USER, ASSISTANT, USER)  # the state after an inserted or given role, which is the only one that fits
NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_NEVER = float("inf")

#: A step of the search: rows to delete, or (one row's initial, whether it is truncated).
Step = int | tuple[str, bool]


def bounds(steps: tuple[Step, ...], ends: tuple[int, ...]) -> list[list[float]]:
    """[steps done][state]: the least that the rest can cost."""
    out: list[list[float]] = [[0.0 if q in ends else _NEVER for q in range(4)]]
    for k in range(len(steps), -1, -1):
        if k < len(steps):
            step, after = steps[k], out[-1]
            if isinstance(step, int):
                out.append([DELETE * step + after[q] for q in range(4)])
            else:
                initial, cut = step
                more = TRUNCATED * cut
                out.append([min(DELETE + after[q], REROLE + more + after[TURN[q]], KEEP + more + (after[_KEPT[initial, q]] if (initial, q) in _KEPT else _NEVER)) for q in range(4)])
        own = out[-1]
        for _ in range(2):  # no path inserts more than twice in a row for nothing
            for q in range(4):
                own[q] = min(own[q], INSERT + own[TURN[q]])
    return out[::-1]


@lru_cache(1 << 14)
def searched(steps: tuple[Step, ...], start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, edits) of the best repair that leads from a state to one of the ends; None if none does."""
    least = bounds(steps, ends)
    if least[0][start] == _NEVER:
        return None
    stack: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    while stack:
        cost, edits, k, q = stack.pop()
        if best and (cost + least[k][q] > best[0] or (cost + least[k][q] == best[0] and edits > best[1][: len(edits)])):
            continue
        if seen.get((k, q), (_NEVER, "")) <= (cost, edits):
            continue
        seen[k, q] = (cost, edits)
        if k == len(steps) and q in ends and (best is None or (cost, edits) < best):
            best = (cost, edits)
        after = [(INSERT, "I", k, TURN[q])]
        if k < len(steps):
            step = steps[k]
            if isinstance(step, int):
                after.append((DELETE * step, "D" * step, k + 1, q))
            else:
                initial, cut = step
                after.append((DELETE, "D", k + 1, q))
                after.append((REROLE + TRUNCATED * cut, "R", k + 1, TURN[q]))
                if (initial, q) in _KEPT:
                    after.append((KEEP + TRUNCATED * cut, "K", k + 1, _KEPT[initial, q]))
        # The most promising last, as it is taken first; edits in the order of their letters.
        after.sort(key=lambda x: (cost + x[0] + least[x[2]][x[3]], x[1]), reverse=True)
        stack += [(cost + c, edits + e, i, s) for c, e, i, s in after if least[i][s] < _NEVER]
    return best


def _number(n: int | None) -> int | None:
    return n if n is None or -(1 << 63) <= n < 1 << 63 else None


class _Segment:
    """Rows of one conversation that follow each other, as they come."""

    def __init__(self, key: tuple):
        self.key, self.steps, self.rows = key, [], 0
        self.turns: list[int] = []  # first, last
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = ""

    def add(self, turn, role, blank, cut, later, times) -> None:
        initial = role[:1]
        if self.rows:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.illegal += (times - 1) * (initial + initial not in ("su", "ua", "au"))
        self.last, self.rows = initial, self.rows + 1
        if turn is not None and (not self.turns or turn != self.turns[-1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.distinct += 1
        gone = times
        if blank:
            self.blank += times
        else:
            self.duplicate += times if later else times - 1
            self.truncated += not later and cut
            if not later:
                self.steps.append((initial, cut))
                gone -= 1
        if gone and self.steps and isinstance(self.steps[-1], int):
            self.steps[-1] += gone
        elif gone:
            self.steps.append(gone)

    def row(self, conv, alone: bool) -> tuple:
        steps = tuple(self.steps)
        pairs = [(START, ENDS)] if alone else [(a, (b,)) for a in range(4) for b in range(4)]
        found = [searched(steps, a, b) for a, b in pairs]
        numbers = [*(self.turns or [None, None]), self.distinct, self.blank, self.duplicate, self.truncated, self.illegal]
        return (conv, *self.key, numbers, self.first, self.last, [x and x[0] for x in found], [x and x[1] for x in found])


_SEGMENTS = "conv_id long, turn long, role string, mark string, numbers array<long>, first string, last string, costs array<long>, edits array<string>"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _segments(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of (conv_id, turn, role, mark, blank, cut, later, times), sorted. Only a conversation that neither begins nor ends a
    task's rows, and is short, is known to be whole."""
    own, conv, whole = None, None, False
    started = False
    for c, turn, role, mark, blank, cut, later, times in rows:
        if started and c == conv and own.rows < SEGMENT:
            pass
        else:
            if started:
                if c == conv:
                    whole = False
                yield own.row(conv, whole and c != conv)
            whole = started and c != conv
            own, conv, started = _Segment((turn, role, mark)), c, True
        own.add(turn, role, blank, cut, later, times)
    if started:
        yield own.row(conv, False)


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row for each conversation, of its segments in order."""
    conv, state, started = None, None, False
    for c, _, _, _, numbers, first, last, costs, edits in rows:
        if not started or c != conv:
            if started:
                yield _result(conv, state)
            conv, started = c, True
            state = {"turns": [None, None], "counts": [0] * 5, "last": None, "best": {START: (0, "")}}
        low, high, *counts = numbers
        counts[0] -= low is not None and low == state["turns"][1]
        counts[4] += state["last"] is not None and state["last"] + first not in ("su", "ua", "au")
        state["counts"] = [a + b for a, b in zip(state["counts"], counts, strict=True)]
        state["turns"] = [low if state["turns"][0] is None else state["turns"][0], state["turns"][1] if high is None else high]
        state["last"] = last
        best: dict[int, tuple[int, str]] = {}
        pairs = [(START, ASSISTANT)] if len(costs) == 1 else [(a, b) for a in range(4) for b in range(4)]
        for (a, b), cost, audit in zip(pairs, costs, edits, strict=True):
            if cost is not None and a in state["best"]:
                with_it = (state["best"][a][0] + cost, state["best"][a][1] + audit)
                best[b] = min(best.get(b, with_it), with_it)
        state["best"] = best
    if started:
        yield _result(conv, state)


def _result(conv, state) -> tuple:
    low, high = state["turns"]
    distinct, blank, duplicate, truncated, illegal = state["counts"]
    cost, audit = min(state["best"][q] for q in ENDS if q in state["best"])
    gaps = 0 if low is None else _number(high - low + 1 - distinct)
    return conv, gaps, blank, duplicate, truncated, illegal, _number(cost), audit


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows, harmed by a checksum of their conversation and turn; times says how
    often a row stands there, 0 for one that is lost."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).when(kind != 0, name("text"))
    role = F.when(kind == 4, "user").otherwise(name("role"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"))


def prepared(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) of rows as they are."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("times"))


def _mark() -> Column:
    return F.md5(F.col("text").cast("binary"))


def _order(*first: str) -> list[Column]:
    return [*[F.col(c).asc_nulls_first() for c in first], F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows left."""
    tail = F.expr(rf"trim(TRAILING '{SPACES}' FROM text)")
    own = rows.filter("times > 0").select("conv_id", "turn", "role", _mark().alias("mark"), tail.alias("tail"), "times")
    own = own.select("conv_id", "turn", "role", "mark", (F.col("tail") == "").alias("blank"), (~F.right("tail", F.lit(1)).isin(".", "!", "?")).alias("cut"), "times")
    turns = kept(own.groupBy("conv_id", "turn", "role", "mark", "blank", "cut").agg(F.sum("times").alias("times")), "dialogue-turns")
    # Of texts that come at several turns, the first turn: only these are met again.
    first = turns.groupBy(*[F.col(c).alias(f"{c}_of") for c in ("conv_id", "role", "mark")]).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_of")) & (F.col("role") == F.col("role_of")) & (F.col("mark") == F.col("mark_of"))
    later = F.col("n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("at.turn"))
    flagged = kept(turns.join(first, same, "left").select("conv_id", "turn", "role", "mark", "blank", "cut", later.alias("later"), "times"), "dialogue-faults")
    ordered = flagged.repartitionByRange(*_order("conv_id")).sortWithinPartitions(*_order("conv_id"))
    parts = map_rows(ordered, _segments, _SEGMENTS)
    return map_rows(parts.repartition("conv_id").sortWithinPartitions(*_order("conv_id")), _joined, _RESULT)


def _streams(rows: DataFrame) -> DataFrame:
    """Each conversation's audit, if it has rows, and then its rows in order."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    found = audits(rows)
    heads = found.select("conv_id", F.lit(0).alias("kind"), none("long", "turn"), none("string", "role"), none("string", "mark"), none("string", "text"), F.lit(1).cast("long").alias("times"), F.array("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("numbers"), "audit")
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _mark().alias("mark"), "text", "times", none("array<long>", "numbers"), none("string", "audit"))
    return heads.union(body).repartition("conv_id").sortWithinPartitions(*_order("conv_id", "kind"))


class _Repair:
    """A conversation's edits, as its rows pass: gives (turn, role, text, edit) of what remains."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def placed(self, turn, text, edit) -> tuple:
        self.state = TURN[self.state]
        return turn, NAMES[self.state], text, edit

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.placed(None, "", "I")

    def row(self, turn, role, text) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEPT[role[:1], self.state]
            yield turn, role, text, edit
        elif edit == "R":
            yield self.placed(turn, text, edit)


def _followed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of the streams: (conv_id, 'head', numbers, audit) for each conversation, then (conv_id, 'row', row, edit), then
    (conv_id, 'end', ...)."""
    conv, own, started = None, None, False
    for c, kind, turn, role, _, text, times, numbers, audit in rows:
        if not started or c != conv:
            if started:
                for x in own.inserted():
                    yield conv, "row", x
                yield conv, "end", None
            conv, started, own = c, True, _Repair(audit or "")
            yield conv, "head", (numbers or [0] * 6, audit or "")
        if kind:
            for _ in range(times):
                for x in own.row(turn, role, text):
                    yield conv, "row", x
    if started:
        for x in own.inserted():
            yield conv, "row", x
        yield conv, "end", None


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the rows that remain, in order, and what was done to them."""

    def run(stream):
        place = 0
        for conv, what, x in _followed(stream):
            if what == "head":
                place = 0
            elif what == "row":
                place += 1
                yield conv, place, *x

    return map_rows(_streams(rows), run, "conv_id long, place long, turn long, role string, text string, edit string")


def report(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of the table, after its rows are harmed: faults, cost, edits, digest of the repair."""

    def run(stream):
        numbers, audit, digest, first = [], "", None, True
        for conv, what, x in _followed(stream):
            if what == "head":
                (numbers, audit), digest, first = x, hashlib.sha256(), True
            elif what == "row":
                digest.update(b"" if first else b"\n")
                digest.update(f"{x[1]}:{x[2]}".encode())
                first = False
            else:
                yield conv, *numbers, audit, digest.hexdigest()

    return map_rows(_streams(damaged(conversations)), run, _RESULT + ", repaired_sha256 string")
