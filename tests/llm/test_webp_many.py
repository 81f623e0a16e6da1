"""Images decoded together against the decoder that takes one, on real texts and on streams made by hand."""

from collections import Counter

import numpy as np
import pytest

from rollcall.llm import webp

DATA = "/root/testdata/sf0.001"


def by_the_format(rest, wide, tall, block, modes):
    """Predictors undone pixel by pixel, from the format's text."""
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    out = []
    for at in range(wide * tall):
        y, x = divmod(at, wide)
        if at == 0:
            guess = [255, 0, 0, 0]
        elif y == 0:
            guess = out[at - 1]
        elif x == 0:
            guess = out[at - wide]
        else:
            left, top, right, corner = out[at - 1], out[at - wide], out[at - wide + 1], out[at - wide - 1]
            mode = modes[y >> block][x >> block]
            if mode == 11:
                estimate = [a + b - c for a, b, c in zip(left, top, corner)]
                to_left, to_top = (sum(abs(p - q) for p, q in zip(estimate, other)) for other in (left, top))
                guess = left if to_left < to_top else top
            else:
                guess = [
                    lambda: [255, 0, 0, 0],
                    lambda: left,
                    lambda: top,
                    lambda: right,
                    lambda: corner,
                    lambda: half(half(left, right), top),
                    lambda: half(left, corner),
                    lambda: half(left, top),
                    lambda: half(corner, top),
                    lambda: half(top, right),
                    lambda: half(half(left, corner), half(top, right)),
                    None,
                    lambda: [clamp(a + b - c) for a, b, c in zip(left, top, corner)],
                    lambda: [clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner)],
                ][mode]()
        out.append([(a + b) & 255 for a, b in zip(rest[at], guess)])
    return np.array(out)


def test_predictors_of_all_modes():
    rng = np.random.default_rng(8)
    images, want = [], []
    for wide, tall in ((9, 7), (1, 5), (6, 1), (20, 18)):
        rest = rng.integers(0, 256, (wide * tall, 4))
        modes = rng.integers(0, 14, (-(-tall >> 2), -(-wide >> 2)))
        images.append((webp._argb(rest), wide, tall, 2, (modes << 8).reshape(-1)))
        want.append(by_the_format(rest.tolist(), wide, tall, 2, modes.tolist()))
    for args, own, one in zip(images, webp.unpredict_many(images), want):
        assert (webp._split(own) == one).all() and (webp._split(webp._unpredict(*args)) == one).all()


def test_texts_meet_every_part_of_the_decoder(spark, monkeypatch):
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += [b"", b"x", bytes(range(33, 127)) * 400, b"ab" * 9000, "日本語 é ".encode() * 300]
    payloads = [webp.padded(t) for t in texts]
    media = [webp.store(p) for p in payloads]
    met = Counter()
    for name in ("_unpalette", "_uncross", "unpredict_many", "_extended"):
        own = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, own=own, name=name: (met.update([name]), own(*a))[1])
    assert [np.ascontiguousarray(x).tobytes() for x in webp.load_many(media)] == payloads
    assert min(met[n] for n in ("_unpalette", "_uncross", "unpredict_many", "_extended")) > 0
    lengths = {webp.decode_streams(webp._files(m))[0].size for m in media}
    assert len(lengths) > 3
    for m in media:  # and the decoder that takes one file says the same
        one = [webp.decode_one(m, 0)[0]] if len(webp._files(m)) == 1 else None
        if one is not None:
            assert (webp._argb(one[0]).reshape(-1) == webp.decode_streams(webp._files(m))[0]).all()


def test_streams_made_by_hand():
    from test_operators import _file, _head, _solid

    w = _head(2, 1)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    _solid(w, 0xFF102030)
    w.put(0, 1)
    w.put(0, 1), w.put(0, 1)
    for v in (64, 10, 20, 255):
        for x, k in ((1, 1), (0, 1), (1, 1), (v, 8)):
            w.put(x, k)
    for x, k in ((1, 1), (0, 1), (0, 1), (0, 1)):
        w.put(x, k)
    data = _file(w, 2, 1)
    assert (webp.decode_streams(webp._files(data))[0] == webp._argb(webp.decode(data)).reshape(-1)).all()
    with pytest.raises(ValueError):
        webp.decode_streams([webp._files(data)[0][:6]])


def test_damaged_streams():
    media = webp.store(webp.padded(b"some words that repeat, words that repeat " * 50))
    body = webp._files(media)[0]
    with pytest.raises(ValueError):
        webp.decode_streams([body[:-20]])
