"""Repair of conversations against plain searches: all edit sequences in order of cost, and whole tables row by row."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from rollcall.llm import dialogue

DATA = "/root/testdata/sf0.001"
FINE = re.compile(r"(s?(ua)+)?")


def cheapest(rows, thorough=False):
    """(cost, edits, roles' text) by taking prefixes in the order of (cost, edits). rows: (role, text, fault).

    thorough: no prefix is dropped but those that break the pattern or cost more than deleting all."""
    most = 4 * len(rows)
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, k, initials, out = heapq.heappop(heap)
        if k == len(rows) and FINE.fullmatch(initials):
            return cost, edits, out
        node = (k, initials[-1:], len(initials) > 0)
        if not thorough and node in seen:
            continue
        seen.add(node)
        given = "a" if initials.endswith("u") else "u"
        name = {"a": "assistant", "u": "user"}[given]
        ways = [(3, "I", 0, given, (f"{name}:",))]
        if k < len(rows):
            role, text, fault = rows[k]
            ways.append((4, "D", 1, "", ()))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append((3 + more, "R", 1, given, (f"{name}:{text}",)))
                if role[:1] and re.fullmatch(r"s?(ua)*u?", initials + role[:1]):
                    ways.append((more, "K", 1, role[:1], (f"{role}:{text}",)))
        for c, e, step, initial, line in ways:
            if cost + c <= most:
                heapq.heappush(heap, (cost + c, edits + e, k + step, initials + initial, out + line))


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    """[(role, text, fault)] of one conversation's rows in order."""
    out, seen = [], set()
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None))
        seen.add((role, text))
    return out


def plain(rows):
    """{conv_id: row of the report}"""
    by = {r[0]: [] for r in rows}
    for r in harmed(rows):
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        turns = {r[1] for r in own} - {None}
        found = faults(own)
        n = Counter(f for _, _, f in found)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = cheapest(found)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def same(spark, rows, parts=5):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as audit", "1 as times", "2 as mark")
    got = {r[0]: tuple(r[1:]) for r in dialogue.report(frame.repartition(parts)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == v, k


@pytest.mark.parametrize("seed", range(40))
def test_search_against_all_sequences(seed):
    rng = random.Random(seed)
    for _ in range(30):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "u", ""]), str(k), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for k in range(rng.randrange(5 if seed < 20 else 40))]
        steps = tuple(1 if f in ("blank", "duplicate") else (r[:1], f == "truncated") for r, _, f in rows)
        merged = []
        for s in steps:
            if isinstance(s, int) and merged and isinstance(merged[-1], int):
                merged[-1] += s
            else:
                merged.append(s)
        assert dialogue.searched(tuple(merged)) == cheapest(rows, thorough=seed < 20)[:2]


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(spark, rows)


def awkward():
    rng = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", "User", None, ""]), rng.choice(["a b.", "c", "", None, " \t", "d?", "e!\n", f"{t}.", "é." * 3, "\x1c"])))
    rows += [(None, None, "user", "x."), (None, 1, None, None), (None, None, "assistant", "y.")]
    rows += [(900, None, "user", "n.")] * 3 + [(901, 5, "user", "same.")] * 6 + [(902, t, "user", "again.") for t in range(30)]
    return rows + [(903, 0, "user", "long. " * 20000), (903, 1, "assistant", "long " * 20000)]


def test_awkward_rows(spark):
    same(spark, awkward())


def test_long_conversations_in_segments(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", f"{t}.", f"{t}"])) for t in range(400)] + [(8, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(100)]
    same(spark, rows, 3)
    # Segments of any length give the same: here without Spark, cut at every few rows.
    flat = []
    for conv in (7, 8):
        own = sorted((r for r in harmed(rows) if r[0] == conv), key=lambda r: (r[1], r[2], r[3]))
        flat += [(conv, r[1], r[2], r[3], not r[3].strip(), f == "truncated", f == "duplicate", 1) for r, (_, _, f) in zip(own, faults(own), strict=True)]
    whole = list(dialogue._joined(dialogue._segments(iter(flat))))
    for most in (1, 2, 7, 50):
        monkeypatch.setattr(dialogue, "SEGMENT", most)
        assert list(dialogue._joined(dialogue._segments(iter(flat)))) == whole


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "No"), (2, 0, "assistant", "A."), (3, 0, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in dialogue.repaired(dialogue.prepared(frame)).orderBy("conv_id", "place").collect()]
    assert [r[:1] + r[3:] for r in got] == [(1, "user", "Hi.", "K"), (1, "assistant", "Yes.", "K"), (2, "user", "", "I"), (2, "assistant", "A.", "K")]
    found = {r.conv_id: (r.cost, r.audit) for r in dialogue.audits(dialogue.prepared(frame)).collect()}
    assert found == {1: (8, "KDKD"), 2: (3, "IK"), 3: (4, "D")}
    assert dialogue.report(frame.limit(0)).count() == 0
