"""The stages of the corpus pipeline on awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rollcall.llm import crf, rules


def test_near_dedup_keeps_rows_without_ids(spark):
    a, b = ("one two three four five six seven eight " + x for x in ("nine", "ten " * 9))
    rows = [(None, a, "x"), (None, a, "y"), (None, None, "z"), (5, a, "x"), (5, b, "x"), (5, b, "w"), (9, a, "x"), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    # Rows without ids all stay; of id 5 the longest text, first by the other columns; 9 is a copy of 5.
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*rows[:3], (5, b, "w"), (7, None, "x")], key=str)


DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with awkward rows, and extra columns whose names operators like."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    fine = docs.join(spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").collect()
    secret, lang = next((r.text, r.lang) for r in fine if len(r.text.split()) > 150 and "password" not in r.text)
    rows = [(None, secret + " token = abcdef123456 end", lang, "web", 1), (700001, None, None, "web", 0), (700002, "", "en", None, 0), (700003, secret + " password: hunter2222", lang, "web", 1), (700003, secret + " password: hunter2222", lang, "web", 1), (700004, "x " * 30_000, "en", "web", 1)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.union(more).withColumn("_id", F.lit(1)).withColumn("secret_id", F.lit("s")).withColumn("kept_id", F.lit(2)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def key(rows):
    return sorted(((r.doc_id, r.text, r.lang) for r in rows), key=str)


def test_stages_against_plain_code(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    # Quality classifier: the model's own score of each text.
    model = crf.train(docs, labels)
    good = corpus_pipeline.quality_classifier(spark, docs, folder).cache()
    assert good.columns == docs.columns
    assert key(good.collect()) == key(r for r in docs.collect() if model.score((r.text or "").encode()) >= crf.GOOD_FROM)

    # Quality rules: references of each language counted by hand.
    words, chars = defaultdict(Counter), defaultdict(lambda: np.zeros(len(rules.CLASSES)))
    for r in good.collect():
        words[r.lang or ""].update((r.text or "").encode().lower().split())
        chars[r.lang or ""] += rules.char_counts((r.text or "").encode())
    refs = {}
    for lang in chars:
        top = sorted(words[lang].items(), key=lambda x: (-x[1], x[0]))[: rules.COMMON]
        shares = np.array([n for _, n in top] + [sum(words[lang].values()) - sum(n for _, n in top)], float)
        refs[lang] = (chars[lang] / max(chars[lang].sum(), 1), {w: k for k, (w, _) in enumerate(top)}, shares / max(shares.sum(), 1))
    fair = corpus_pipeline.quality_rules(spark, good, folder).cache()
    assert fair.columns == docs.columns
    assert key(fair.collect()) == key(r for r in good.collect() if rules.verdict((r.text or "").encode(), r.lang or "", refs)[-3])

    # Near dedup: all pairs of shingle sets.
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {r.doc_id: shingles(r.text) for r in fair.collect() if r.doc_id is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sorted(sets):
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    single = corpus_pipeline.near_dedup(spark, fair, folder).cache()
    got = single.collect()
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [i for i in sorted(sets) if find(i) == i]
    assert sum(r.doc_id is None for r in got) == sum(r.doc_id is None for r in fair.collect())

    # Secret scans: nothing is left that the base patterns find; texts without secrets stay.
    masked = corpus_pipeline.secret_scans(spark, single, folder).cache()
    assert masked.columns == docs.columns and masked.count() == len(got)
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.IGNORECASE)
    for r in masked.collect():
        assert not assign.search(r.text or "") and not re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text or "")
    before = {r.doc_id: r.text for r in got}
    changed = [r for r in masked.collect() if before[r.doc_id] != r.text]
    assert changed and all("[SECRET]" in r.text for r in changed)

    # Packing: every token of every document once.
    t = Tokenizer.from_file(VOCABULARY)
    want = sorted(((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in masked.collect()), key=str)
    pieces = corpus_pipeline.pack(spark, masked, folder).collect()
    total = Counter()
    for p in pieces:
        total[p.doc_id, p.doc_tokens] += p.length
    assert sorted(total, key=str) == want and all(n == tokens for (_, tokens), n in total.items())


def test_run_ends_in_the_same_pieces(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    of = lambda df: sorted(((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect()), key=str)
    assert of(corpus_pipeline.run(spark, folder)) == of(docs)


def test_stages_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
