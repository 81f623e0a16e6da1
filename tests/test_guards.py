"""Argument guards, packs of rules, exports, sources that are no good, and clashing column names."""

import pytest
from pyspark.sql import functions as F

from rollcall.functions import vocabulary as V
from rollcall.operators import export as X
from rollcall.operators import filters
from rollcall.operators import intake as I
from rollcall.operators import suppression as S
from rollcall.operators.latest import best_of
from rollcall.operators.percentiles import nearest_rank
from rollcall.operators.runs import chain_breaks, consecutive, within_budget
from rollcall.sources.delimited import read_strings


def test_arguments():
    assert filters.between("limit", 5000, 1, 5000) == 5000
    for bad in (0, 5001, "7", True):
        with pytest.raises(ValueError):
            filters.between("limit", bad, 1, 5000)


def test_unverified_sources_are_not_read(spark):
    with pytest.raises(ValueError):
        read_strings(spark, "/nowhere.csv", verified=False)


def test_unterminated_quotes_raise_where_asked(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\n')
    assert read_strings(spark, str(tmp_path / "x.csv")).count() == 1
    with pytest.raises(ValueError):
        read_strings(spark, str(tmp_path / "x.csv"), strict=True)


def test_packs():
    base = {"name": "base", "entries": [("a", 1), ("b", 2)]}
    assert V.merged_packs([base, {"name": "more", "entries": [("a", 3), ("c", 4)], "overrides": ["a"]}]) == {"a": 3, "b": 2, "c": 4}
    for bad in ([base, base], [{"name": "x", "entries": [("a", 1), ("a", 2)]}]):
        with pytest.raises(ValueError):
            V.merged_packs(bad)
    assert V.version(base) == V.version(dict(reversed(base.items()))) != V.version([]) and len(V.version(base)) == 16


def test_columns_of_the_exports():
    assert (len(X.FULL), len(X.CONTACTS), len(X.STAFF)) == (37, 5, 42)


def test_last_check_before_a_file(spark):
    people = spark.createDataFrame([(1, "a@x.org")], "person long, address string")
    named = spark.createDataFrame([(2,)], "person long")
    S.assert_none(people, named, "person")
    with pytest.raises(ValueError):
        S.assert_none(people, named.union(spark.createDataFrame([(1,)], "person long")), "person")


def test_reconciliation(spark):
    found, stated = (spark.createDataFrame(r, "k string, n long") for r in ([("a", 1), ("b", 2)], [("a", 1), ("c", 3)]))
    report = I.reconciled(found, stated, "k", "n")
    assert {r.k: r.state for r in report.collect()} == {"a": "equal", "b": "unexpected", "c": "missing"}
    with pytest.raises(ValueError):
        I.assert_reconciled(report)


def test_helper_columns_leave_others_alone(spark):
    rows = [(1, 1, 5, 7, 8, 9, 1), (1, 2, 5, 7, 8, 9, 0)]
    df = spark.createDataFrame(rows, "k long, o long, rank long, before long, wrong long, run long, bad long")
    for out in (best_of(df, ["k"], [F.col("o")]), within_budget(df, ["k"], ["o"], 1), chain_breaks(df, ["k"], ["o"], "o", "o"), consecutive(df, ["k"], ["o"], F.col("bad") == 1).drop("streak")):
        assert out.columns == df.columns and [tuple(r) for r in out.collect()][0][2:6] == (5, 7, 8, 9)


def test_exact_percentiles(spark):
    rows = [("a", float(k % 7)) for k in range(50)] + [("b", 3.0)] + [("c", None)] + [("d", 10.0**k) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.p95 for r in nearest_rank(df, "g", "v", 0.95, blocks=8).collect()}
    for g in "abd":
        own = sorted(v for k, v in rows if k == g)
        assert got[g] == own[-(-95 * len(own) // 100) - 1]
    assert set(got) == set("abd")
