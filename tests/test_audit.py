"""Canonical JSON against equal and unequal texts; chains that are continued."""

import pytest

from rollcall.functions.canonical_json import canonical


@pytest.mark.parametrize("raw, want", [
    ('{"bb":1,"a":2,"ab":3,"é":4}', '{"a": 2, "ab": 3, "bb": 1, "é": 4}'),
    ('{"a":{"d":[],"c":{}},"a":{"x":[1,{"z":0,"y":-0.0}]}}', '{"a": {"x": [1, {"y": 0.0, "z": 0}]}}'),
    ("[1e3, 1.50, -2E-3, 12345678901234567890123, 1.0]", "[1000, 1.50, -0.002, 12345678901234567890123, 1.0]"),
    (r'"Aé😀\/\t\u001f\"\\"', r'"Aé😀/\t\u001f\"\\"'),
    (" true ", "true"), ("null", "null"), ("[NaN]", None), ("{", None), ("", None), (r'"\u0000"', None), (r'"\\u0000"', r'"\\u0000"'), ("[" * 100_000, None),
    ("[" * 400 + "]" * 400, "[" * 400 + "]" * 400),
])
def test_canonical(raw, want):
    assert canonical(raw) == want
    assert want is None or canonical(want) == want


@pytest.mark.parametrize("adaptive", ["10MB", "-1"])
def test_continued_chains_stay_whole_whatever_the_join(spark, adaptive):
    """A join that becomes a broadcast only while it runs must not leave a chain's events in several tasks."""
    from pyspark.sql import functions as F

    from rollcall.operators.audit import chained

    e = spark.range(0, 400, 1, 8).select((F.col("id") % 3).alias("chain"), F.col("id").alias("sequence"), F.timestamp_seconds("id").alias("occurred"), *[F.lit("x").alias(c) for c in ("actor_type", "actor", "action", "subject_type", "subject")], F.lit(None).cast("string").alias("metadata"))
    want = {(r.chain, r.sequence): r.hash for r in chained(e).collect()}
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": adaptive, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        first = chained(e.filter("sequence < 50"))
        last = first.groupBy("chain").agg(F.max_by("hash", "sequence").alias("hash"))
        got = {(r.chain, r.sequence): r.hash for r in chained(e.filter("sequence >= 50"), last=last).collect()}
    finally:
        for name in names:
            spark.conf.unset(name)
    assert got == {k: v for k, v in want.items() if k[1] >= 50}
