from pyspark.sql import functions as F

from rollcall.sinks import csv_lines
from rollcall.sources.delimited import read_delimited
from rollcall.streaming.incremental import arrivals, ingest


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', 1), (" lead", "two\nlines", 2), (None, "", None)], "a string, b string, n int")
    lines = [r.value for r in csv_lines(df).collect()]
    assert lines == ['"a,b","say ""x""",1', '" lead","two\nlines",2', ",,"]
    path = tmp_path / "x.csv"
    path.write_text("a,b,n\r\n" + "\r\n".join(lines) + "\r\n")
    back = read_delimited(spark, str(path), "a string, b string, n int").collect()
    assert [(r.a, r.b, r.n) for r in back] == [("a,b", 'say "x"', 1), (" lead", "two\nlines", 2)]


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
        ingest(arrivals(spark, source, "id long"), target, state).awaitTermination()
        out = spark.read.parquet(target)
        assert out.count() == 10 * (k + 1) == out.agg(F.count_distinct("id")).first()[0]
