"""Deep, cyclic and dated hierarchies against brute force."""

import pytest

from rollcall.operators.graph import ancestry, cycles, descendants, hierarchy, subtree


@pytest.fixture(scope="module")
def chain(spark):
    """0 above 1 above 2 ... above 25, with a way back from 25 to 24 and a second parent."""
    return spark.createDataFrame([*((k, k + 1) for k in range(25)), (25, 24), (3, 9)], "parent long, child long").cache()


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_subtree_reaches_all_depths(spark, chain):
    assert sorted(r.node for r in subtree(nodes(spark, 1, 1), chain).collect()) == list(range(1, 26))
    assert subtree(nodes(spark), chain).count() == 0


def test_ancestry_reaches_depth_12(spark):
    line = spark.createDataFrame([(k, k + 1) for k in range(15)], "parent long, child long")
    got = {(r.ancestor, r.depth) for r in ancestry(nodes(spark, 14), line).collect()}
    assert got == {(14 - k, k) for k in range(13)}


def test_edges_of_a_day(spark):
    rows = [(1, 2, "2020-01-01", None), (2, 3, "2020-01-01", "2020-06-30"), (1, 4, "2020-07-01", None)]
    edges = spark.createDataFrame(rows, "parent long, child long, a string, b string").selectExpr("parent", "child", "date(a) AS effective_from", "date(b) AS effective_to")
    of = lambda day: sorted(r.node for r in subtree(nodes(spark, 1), edges, as_of=day).collect())
    assert (of("2019-12-31"), of("2020-06-30"), of("2020-07-01"), of(None)) == ([1], [1, 2, 3], [1, 2, 4], [1, 2, 3, 4])
    up = lambda day: sorted(r.ancestor for r in ancestry(nodes(spark, 3), edges, as_of=day).collect())
    assert (up("2020-06-30"), up("2020-07-01")) == ([1, 2, 3], [3])


def test_far_nodes_of_many_origins(spark):
    """Chains longer than the walk, with a ring at the end, a shortcut and origins in the middle."""
    links = [(k, k + 1) for k in range(60)] + [(60, 50), (3, 20), (70, 71)]
    edges = spark.createDataFrame(links, "parent long, child long")
    got = {(r.node, r.ancestor): r.depth for r in hierarchy(nodes(spark, 55, 20, 0, 71), edges).collect()}
    up = {}
    for a, b in links:
        up.setdefault(b, []).append(a)
    want = {}
    for n in (55, 20, 0, 71):
        seen, level, depth = {n}, [n], 0
        while level:
            depth += 1
            level = sorted({p for x in level for p in up.get(x, [])} - seen)
            seen.update(level)
            want |= {(n, p): depth for p in level}
    assert got == want
    down = {(r.node, r.descendant) for r in descendants(nodes(spark, 2, 71), edges).collect()}
    assert down == {(2, k) for k in range(2, 61)} | {(71, 71)}


def dated(spark, rows):
    return spark.createDataFrame(rows, "child long, parent long, a string, b string").selectExpr("child", "parent", "date(a) AS effective_from", "date(b) AS effective_to")


def test_cycles_among_many_ways(spark):
    """Thirteen layers of three nodes: 3 ** 12 ways up, and an edge back that is in force with none, then one, of them."""
    up = [(10 * k + i, 10 * (k + 1) + j, "2020-01-01", "2020-12-31") for k in range(12) for i in range(3) for j in range(3)]
    none, one = (121, 2, "2021-01-01", None), (121, 2, "2020-12-31", None)
    assert cycles(dated(spark, up), dated(spark, [none])).count() == 0
    assert [r.node for r in cycles(dated(spark, up), dated(spark, [none, one])).collect()] == [121]
    every = {r.node for r in cycles(dated(spark, [*up, one])).collect()}
    assert every == {2, 121} | {10 * k + i for k in range(1, 12) for i in range(3)}


def test_intervals_of_a_ring(spark):
    ring = [(1, 2, None, "2020-06-30"), (2, 3, "2020-03-01", None), (3, 1, "2020-07-01", None), (3, 1, "2020-06-30", "2020-06-30"), (4, 1, None, None), (5, 5, None, None), (6, 6, "2021-01-01", "2020-01-01")]
    assert sorted(r.node for r in cycles(dated(spark, ring)).collect()) == [1, 2, 3, 5]
    assert sorted(r.node for r in cycles(dated(spark, [r for r in ring if r[3] != "2020-06-30" or r[0] == 1])).collect()) == [5]
