"""Names, folds of records and graphs against plain code and known cases."""

import pytest

from rollcall.functions import names as N
from rollcall.operators.graph import cycles, descendants, hierarchy
from rollcall.operators.latest import folded_records


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Jane Smith", (None, "Jane", None, "Smith", None, False)),
        ("Smith, Jane M.", (None, "Jane", "M.", "Smith", None, False)),
        ("Jane Smith, Ed.D.", (None, "Jane", None, "Smith", "Ed.D.", False)),
        ("Smith, Robert Jr.", (None, "Robert", None, "Smith", "Jr.", False)),
        ("John Smith, Ph.D., Jr.", (None, "John", None, "Smith", "Jr., Ph.D.", False)),
        ("Dr. Maria de la Cruz", ("Dr.", "Maria", None, "de la Cruz", None, False)),
        ("JOHN MCDONALD", (None, "John", None, "McDonald", None, False)),
        ("ANNE O'BRIEN-SMITH III", (None, "Anne", None, "O'Brien-Smith", "III", False)),
        ("Cher", (None, None, None, "Cher", None, True)),
        ("", (None, None, None, None, None, True)),
        (",", (None, None, None, None, None, True)),
        (None, (None, None, None, None, None, True)),
    ],
)
def test_parsed_names(raw, want):
    published, display, *rest = N.parsed(raw)
    prefix, first, middle, last, suffix, low = rest
    assert (prefix, first, middle, last, suffix, low) == want and published == raw


def test_folded_records(spark):
    rows = [("r1", "p", 1, 0.5, None, ["a"]), ("r1", "p", 2, 0.9, "x", ["b", "a"]), ("r2", "p", 3, 0.9, "y", ["c"]), ("r3", "q", 4, 0.1, None, []), ("r3", "q", 5, 0.1, "z", ["d"])]
    df = spark.createDataFrame(rows, "record string, person string, arrival long, confidence double, phone string, addresses array<string>")
    got = {r.person: r for r in folded_records(df, "record", "person", "arrival", "confidence", ["phone"], ["addresses"]).collect()}

    def merge(a, b):
        first, second = (a, b) if a[3] >= b[3] else (b, a)
        return (first[0], first[1], a[2], first[3], first[4] or second[4], first[5] + [x for x in second[5] if x not in first[5]])

    for person in "pq":
        by_key = {}
        for r in rows:
            if r[1] == person:
                by_key[r[0]] = merge(by_key[r[0]], r) if r[0] in by_key else r
        want, *more = by_key.values()
        for r in more:
            want = merge(want, r)
        assert tuple(got[person]) == (want[2], want[3], want[0], want[1], want[4], want[5])


def test_hierarchies(spark):
    chain = [(k, k + 1) for k in range(40)] + [(40, 39), (5, 20)]
    edges = spark.createDataFrame(chain, "parent long, child long")
    nodes = spark.createDataFrame([(k,) for k in (0, 20, 40)], "node long")
    up = {}
    for r in hierarchy(nodes, edges).collect():
        up.setdefault(r.node, {})[r.ancestor] = r.depth
    assert 0 not in up and up[20][5] == 1 and up[20][0] == 6 and set(up[40]) == set(range(40)) and up[40][5] == 21
    down = {}
    for r in descendants(nodes, edges).collect():
        down.setdefault(r.node, set()).add(r.descendant)
    assert down[0] == set(range(41)) and down[40] == {39, 40}


def test_cycles_need_a_common_day(spark):
    rows = [(1, 2, "2020-01-01", None), (2, 1, "2020-06-01", None), (3, 4, "2020-01-01", "2020-03-01"), (4, 3, "2020-03-02", None), (5, 6, None, None)]
    edges = spark.createDataFrame(rows, "parent long, child long, a string, b string").selectExpr("parent", "child", "date(a) AS effective_from", "date(b) AS effective_to")
    assert sorted(r.node for r in cycles(edges).collect()) == [1, 2]
