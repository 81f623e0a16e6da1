"""Rules on more languages than references are held for."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rollcall.llm import rules


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for k in range(9):
        words = [f"{chr(97 + k)}{'xyzuvw'[j % 6]}{j}" for j in range(90)]
        for i in range(3 + k):
            own = words[:40] if i else words[50:] + ["#$%"] * 40
            rows.append((100 * k + i, " ".join(rng.choice(own) for _ in range(150 + 20 * k)), None if k == 8 else f"l{k}", k))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, chars long").cache()


def by_hand(docs):
    words, chars = defaultdict(Counter), defaultdict(lambda: np.zeros(8))
    for r in docs:
        words[r.lang or ""].update(r.text.encode().lower().split())
        chars[r.lang or ""] += rules.char_counts(r.text.encode())
    refs = {}
    for lang, own in words.items():
        top = sorted(own.items(), key=lambda x: (-x[1], x[0]))[: rules.COMMON]
        p = np.array([n for _, n in top] + [sum(own.values()) - sum(n for _, n in top)], float)
        refs[lang] = (chars[lang] / chars[lang].sum(), {w: k for k, (w, _) in enumerate(top)}, p / p.sum())
    return {r.doc_id: rules.verdict(r.text.encode(), r.lang or "", refs) for r in docs}


@pytest.mark.parametrize("most", [0, 2, 8, 9, 512])
def test_every_language_has_its_reference(docs, monkeypatch, most):
    monkeypatch.setattr(rules, "LANGUAGES", most)
    want = by_hand(docs.collect())
    got = {r.doc_id: tuple(r)[1:] for r in rules.judged(docs).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:7] == w[:7] and got[i][7:] == pytest.approx(w[7:])
    assert {w[6] for w in want.values()} == {True, False}
    kept = rules.filtered(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[6])
