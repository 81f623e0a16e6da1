"""Mixing against a plain version: targets by filling, copies by systematic sampling, awkward rows."""

import math
import re
from collections import Counter
from fractions import Fraction

import pytest

from rollcall.llm import mixing

DATA = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, cap=3, share=1):
    """{source: target}, by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: Fraction(k % 3 + 1) for k, s in enumerate(order)}
    left, target, free = Fraction(sum(sizes.values())) * share, {}, list(order)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not above:
            return target | {s: weight[s] * level for s in free}
        for s in above:
            target[s] = Fraction(cap * sizes[s])
            left -= target[s]
        free = [s for s in free if s not in above]


def held(rows, got, cap=3):
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += words(text)
    want, longest, taken = filled(sizes, cap), Counter(), Counter()
    assert len(got) == len(rows)
    for _, source, text in rows:
        longest[source] = max(longest[source], words(text))
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    for r in got:
        if len(by_id[r.doc_id]) == 1:
            ((_, source, text),) = by_id[r.doc_id]
            assert r.size == words(text) and r.source_size == sizes[source]
            assert r.target == pytest.approx(float(want[source]), rel=1e-12)
            expected = float(want[source]) / sizes[source] if sizes[source] else 0
            copies = r.taken / r.size if r.size else 0
            assert not r.size or math.floor(expected) <= copies <= math.ceil(expected) <= cap
            taken[source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2 * longest[s] + 1, (s, t, want[s])


ROWS = [(k, "big" if k % 3 else ["é", "b", "zz", None][k // 3 % 4], " ".join(["w"] * (k % 40))) for k in range(600)] + [(900, "empty", None), (901, "empty", ""), (902, "small", "one two"), (903, "large", "x " * 30000), (904, "\U0001f600", "a b c"), (905, "￮", "a b c d")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_and_copies(spark):
    got = mixing.report(frame(spark, ROWS).repartition(7)).collect()
    held(ROWS, got)
    assert sorted(mixing.report(frame(spark, ROWS).repartition(3)).collect()) == sorted(got)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held([(r.doc_id, r.source, r.text) for r in docs.collect()], mixing.report(docs).collect())


def test_mixture_repeats_whole_rows(spark):
    docs = frame(spark, ROWS).selectExpr("*", "doc_id as size", "'t' as target", "1 as copies", "2 as place")
    got, taken = Counter(r.doc_id for r in mixing.mixture(docs).collect()), {r.doc_id: r for r in mixing.report(docs).collect()}
    for i, r in taken.items():
        assert got[i] * r.size == r.taken
    assert mixing.mixture(docs).columns == docs.columns


def test_shares_and_caps(spark):
    got = mixing.targets(spark.createDataFrame([("a", 100), ("b", 1), ("c", 0), ("d", 50)], "source string, size long"), share=Fraction(1, 2), cap=2)
    # a, d weigh 1, b 2, c 3: b and c are full at 2 and 0, what is left of 75 is shared by a and d.
    assert {r.source: r.target for r in got.collect()} == {"a": 36.5, "b": 2.0, "c": 0.0, "d": 36.5}


def test_rows_without_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "s", "a b")] * 5 + [(7, "s", "a b")] * 5 + [(8, None, None)]
    got = mixing.report(frame(spark, rows)).collect()
    assert len(got) == 11 and sum(r.taken for r in got) in range(18, 23)
    assert mixing.report(frame(spark, rows).limit(0)).count() == 0
    only_empty = mixing.report(frame(spark, [(1, "s", None), (2, "t", " ")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in only_empty] == [(0, 0, 0.0, 0)] * 2
