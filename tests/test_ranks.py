"""Places in an order against plain sorting, with groups far from even."""

from pyspark.sql import functions as F

from rollcall.operators.filters import numbered
from rollcall.operators.ranks import placed


def test_places_within_groups(spark):
    rows = [(None if k % 11 == 0 else ("hot" if k % 3 else f"g{k % 5}"), k % 7, k, "x") for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, a int, b int, _at string").repartition(13)
    got = placed(df, [F.col("a").desc(), F.col("b")], "place", ["g"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = k
    assert {r.b: r.place for r in got} == want and len(got) == len(rows)
    assert got[0]._at == "x"


def test_places_of_text_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(f"k{k % 50:02}",) for k in range(100)], "k string")
    got = numbered(df, "k", "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(100)) and [r.k for r in got] == sorted(r.k for r in got)
    assert numbered(df.limit(0), "k", "place").count() == 0
