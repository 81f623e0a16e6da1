"""Whitening against a plain version on numpy's own solver; the solver on hard matrices; awkward rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rollcall.llm import whitening

DATA = "/root/testdata/sf0.001"


def plain(rows):
    """[(vec_id, x)] and the model of rows (vec_id, vector), in one process."""
    own = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in own}), np.float64)
    centred = fit - fit.mean(0)
    values, columns = np.linalg.eigh(centred.T @ centred / len(fit))
    return own, fit, values[::-1], columns[:, ::-1]


def held(rows, got, most=4):
    own, fit, values, columns = plain(rows)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    assert len(got) == most * len(own)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, x in own:
        for k in range(most):
            for r in by[i, k + 1]:
                assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
                want = sum((a - Fraction(s, n)) * Fraction(c) for a, s, c in zip(x, sums, columns[:, k].tolist(), strict=True)) / Fraction(math.sqrt(values[k]))
                if abs(want) > 1e-3:
                    signs.setdefault(k, r.whitened * float(want) > 0)
                sign = 1 if signs.get(k, True) else -1
                assert r.whitened == pytest.approx(sign * float(want), abs=1e-8)
                assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-10) and r.identity_error < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 as component", "'x' as n")


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    held(rows, whitening.report(spark.read.parquet(f"{DATA}/embeddings.parquet").repartition(5)).collect())


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    base = [(k, [float(np.float32(c)) for c in rng.normal(k % 3, (3, 1, 0.5, 2, 0.1, 1))]) for k in range(200)]
    rows = base + base[:50] + [(None, base[0][1]), (900, None), (901, []), (902, [None] * 6), (903, [math.nan] + [0.0] * 5), (904, [math.inf] * 6), (905, [1.0] * 6)] + [(1000 + k, [0.5] * 6) for k in range(300)]
    got = whitening.report(frame(spark, rows + [(906, [1.0, 2.0])]).repartition(9)).collect()
    assert 906 not in {r.vec_id for r in got}
    held(rows, got)


def test_nothing_to_project(spark):
    assert whitening.report(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.report(frame(spark, [(1, [1.0])]).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = whitening.report(frame(spark, [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


def test_deviations_beyond_64_bits(spark):
    got = {(r.vec_id, r.component): r for r in whitening.report(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 3.0]), (3, [1e8, 5.0])])).collect()}
    assert got[1, 1].deviation is None and got[1, 1].n == 3
    own = [[(1 << 63) - 1, 0], [-(1 << 63), 768], [round(1e8) * 256, 1280]]
    sums = [sum(c) for c in zip(*own, strict=True)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in own]
    assert [got[k, 1].deviation for k in (1, 2, 3)] == [w if w < 1 << 63 else None for w in want]


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "diagonal", "rank", "wilkinson", "one", "two"])
def test_solver(kind):
    rng = np.random.default_rng(5)
    base = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    spectrum = {"random": rng.random(40), "clustered": 1 + 1e-9 * rng.random(40), "equal": np.repeat([3.0, 3, 3, 1], 10), "rank": np.append(np.zeros(38), [2.0, 5])}
    if kind in spectrum:
        a = base * spectrum[kind] @ base.T
    elif kind == "diagonal":
        a = np.diag([1.0, 5, 5, 2, 0, 9])
    elif kind == "wilkinson":
        a = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    else:
        a = np.array([[4.0]]) if kind == "one" else np.array([[2.0, 1], [1, 2]])
    a = (a + a.T) / 2
    values, columns = whitening.components(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    want = want[want > 1e-12]
    norm = np.abs(want).max()
    assert np.allclose(values, want, rtol=0, atol=1e-13 * norm)
    assert np.abs(columns.T @ columns - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ columns - columns * values).max() < 1e-12 * norm
