"""Ids that come with several texts, against plain search; columns that can't be compared."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import neardup


def plain(rows):
    """{(doc_id, n_shingles): component} by all pairs of ids, each with all its texts."""

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return sorted((i, len(shingles(t)), find(i), find(i) == i) for i, t in rows)


def test_ids_with_several_texts(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(9)) for _ in range(60)) for _ in range(4))
    rows = [(5, a), (5, b), (9, b + " w"), (10, a + " w"), (3, c), (3, d), (3, c), (20, c + " x"), (21, d), (30, d + " y"), (2, None), (2, a + " v"), (40, "one two"), (40, "three"), (41, "three"), (1, b + " u"), (1, "other words are here"), (50, ""), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, neardup.linked(docs).collect())) == plain(rows)


def test_many_ids_with_several_texts(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(40)}" for _ in range(50)) for _ in range(12)]
    rows = []
    for _ in range(150):
        words = rng.choice(base).split()
        words[rng.randrange(50)] = f"x{rng.randrange(5)}"
        rows.append((rng.randrange(100), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.linked(docs).collect())) == plain(rows)


def test_one_row_of_each_id_with_columns_of_any_type(spark):
    rows = [(1, "a b", {"k": 2}), (1, "a b", {"k": 1}), (1, "a", {"k": 0}), (2, "c", None), (2, None, {"k": 9})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>").withColumn("v", F.parse_json(F.lit('{"z": 1}')))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.more) for r in got.drop("v").collect()) == [(1, "a b", {"k": 1}), (2, "c", None)]
