"""The log-bilinear model: normalised scores, held-out texts, vocabulary steps, awkward rows."""

import numpy as np
import pytest

from rollcall.llm import lm


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words, share = lm.vocabulary(lm.counts(docs))
    units = lm.unit_table(docs, words)
    return docs, words, units, lm.Model(lm.train(units, share))


def test_scores_against_a_direct_softmax(fitted):
    docs, words, units, model = fitted
    got = {r.doc_id: r for r in lm.scored(docs).collect()}
    known = words.build()
    counts = {w: n for w, n in zip(words.words, words.n.tolist())}
    for r in docs.orderBy("doc_id").limit(12).collect():
        own, _ = known.units((r.text or "").encode().lower().split())
        near = far = 0
        total = 0.0
        for k, unit in enumerate(own.tolist()):
            scores = ((model.near[near] + model.far[far]) @ model.vectors.T + model.bias).astype(float)
            p = np.exp(scores - scores.max())
            total += np.log10(p[unit] / p.sum())
            near, far = unit, near
        # Words outside the model: their share of their class.
        for w in (r.text or "").encode().lower().split():
            if known.at.get(w, lm.MODEL_WORDS + 1) > lm.MODEL_WORDS:
                total += np.log10(counts.get(w, 0) + 1) - np.log10(words.class_size[lm.suffix_class(w)] + 1)
        assert got[r.doc_id].score == pytest.approx(total, rel=1e-4)


def test_normalised(fitted):
    model = fitted[-1]
    whole = sum(10 ** model.log10(np.array([3, k, 0]))[1] for k in range(1, lm.UNITS)) + 10 ** model.log10(np.array([3, 0]))[1]
    assert whole == pytest.approx(1, abs=1e-3)


def test_held_out_texts_score_above_the_base(spark):
    got = lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert len(got) > 80 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_words_of_one_step(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)
    counted = spark.createDataFrame([(b"w%04d" % k, 1) for k in range(2000)], "word binary, n long")
    words, _ = lm.vocabulary(counted)
    assert words.words == [b""] + [b"w%04d" % k for k in range(lm.MODEL_WORDS)]


def test_awkward_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "a b", "y"), (1, "a b", "y"), (2, "word " * 60_000, "z"), (3, "é \x1c ü", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.held_out) for r in lm.scored(docs).collect()))
    assert [g[:2] for g in got] == [(0, 1), (1, 1), (1, 3), (1, 3), (2, 60_001), (3, 4)]
    assert not got[0][2]


def test_models_add_up_in_a_tree(spark):
    rows = [(4096 * (k % 2), 2, [float(k), 1.0]) for k in range(20)]
    models = spark.createDataFrame(rows, lm.MODEL_SCHEMA).repartition(7)
    got = {r.block: (r.n, r.sums) for r in lm._added(models, at_once=3).collect()}
    assert got == {0: (20, [90.0, 10.0]), 4096: (20, [100.0, 10.0])}
