"""The line model: gradients, windows, awkward and missing rows."""

import numpy as np
import pytest

from rollcall.llm import crf


@pytest.fixture(scope="module")
def examples():
    rng = np.random.default_rng(2)
    width = crf.OWN + 2 * len(crf.BESIDE)
    return [(rng.normal(size=(n, width)), int(y)) for n, y in zip((1, 5, 9, 2, 7, 5), rng.integers(0, 2, 6))]


def test_gradient_against_finite_differences(examples):
    c = crf.chains(examples, window=4)
    width = c.x.shape[1]
    at = np.random.default_rng(3).normal(size=width + 4) * 0.3
    of = lambda v: crf.gradient(c, v[:width], v[width:].reshape(2, 2))
    _, g = of(at)
    for k in range(len(at)):
        step = np.zeros_like(at)
        step[k] = 1e-5
        assert g[k] == pytest.approx((of(at + step)[0] - of(at - step)[0]) / 2e-5, abs=1e-5)


def test_likelihood_against_all_labellings(examples):
    c = crf.chains(examples[:2])
    rng = np.random.default_rng(4)
    weights, moves = rng.normal(size=c.x.shape[1]) * 0.3, rng.normal(size=(2, 2))
    want = 0.0
    for x, label in examples[:2]:
        lean, total = x @ weights, 0.0
        for k in range(1 << len(x)):
            y = [k >> t & 1 for t in range(len(x))]
            total += np.exp(sum(v * s for v, s in zip(lean, y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        want += lean.sum() * label + moves[label, label] * (len(x) - 1) - np.log(total)
    assert crf.gradient(c, weights, moves)[0] == pytest.approx(want)


def test_windows_hold_every_line(examples):
    c = crf.chains(examples, window=4)
    assert len(c.x) == sum(len(x) for x, _ in examples) == c.sizes.sum() and c.sizes.max() == 4
    assert sorted(map(tuple, c.x)) == sorted(tuple(r) for x, _ in examples for r in x)


def test_awkward_rows(spark):
    rows = [(1, "good line here\nmore", 0.5), (2, "#### ####\n$$$$ !!!!", 0.5), (3, None, 0.5), (4, "", 0.5), (None, "no id", 0.5), (2, "#### ####\n$$$$ !!!!", 0.5), (6, "x\n" * 900, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 0), (6, 0, 1), (None, 1, 0)], "doc_id long, quality int, score int")
    model = crf.train(docs, labels)
    got = crf.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert [r.score for r in got if r.doc_id in (3, 4)] == [model.score(b"")] * 2
    kept = crf.filtered(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) and crf.filtered(docs, model, 1.1).count() == 0
    none = crf.train(docs, labels.limit(0))
    assert {r.score for r in crf.scored(docs, none).collect()} == {0.5}
    assert crf.scored(docs.limit(0), model).count() == 0
    crf.train(docs, labels, lines=3)  # only short texts fit
