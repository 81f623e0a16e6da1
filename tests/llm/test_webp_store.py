"""What stored images are made of: each part of the format where it helps, all read back alike."""

import numpy as np
import pytest

from rollcall.llm import webp

RNG = np.random.default_rng(7)


def transforms(media):
    """Kinds of transforms that a file begins with, by what the decoder undoes."""
    seen = []
    undo = {"_unpredict": 0, "_uncross": 1, "_ungreen": 2, "_unpalette": 3}
    with pytest.MonkeyPatch.context() as m:
        for name, kind in undo.items():
            m.setattr(webp, name, lambda *a, f=getattr(webp, name), kind=kind: (seen.append(kind), f(*a))[1])
        pixels = webp.load(media)
    return seen[::-1], pixels


def smooth():
    y, x = np.mgrid[:40, :64]
    return np.stack([3 * x + y, 2 * y + x, 200 - x - y], -1) + RNG.integers(0, 3, (40, 64, 3))


def correlated():
    green = RNG.integers(-60, 60, (40, 64))
    return np.stack([green + RNG.integers(0, 3, green.shape), green, -green + RNG.integers(0, 3, green.shape)], -1)


@pytest.mark.parametrize(("kind", "payload"), [(3, webp.padded(b"word " * 5000)), (0, smooth()), (1, correlated()), (None, webp.padded(RNG.integers(0, 256, 9000, np.uint8).tobytes()))])
def test_transforms_where_they_help(kind, payload):
    payload = payload if isinstance(payload, bytes) else payload.astype(np.uint8).tobytes()
    media = webp.store(payload)
    kinds, pixels = transforms(media)
    assert pixels.tobytes() == payload
    assert kinds == [] if kind is None else kind in kinds
    assert kind is None or len(media) < 0.8 * len(payload)


def test_texts_have_unequal_codes_copies_and_a_cache(monkeypatch):
    words = [bytes(RNG.integers(97, 123, RNG.integers(2, 9), np.uint8)) for _ in range(300)]
    text = b" ".join(words[int(k)] for k in RNG.zipf(1.3, 9000) % 300)
    payload = webp.padded(text)
    codes, sizes = [], []
    read = webp._read_code
    monkeypatch.setattr(webp, "_read_code", lambda bits, size: (sizes.append(size), codes.append(read(bits, size)), codes[-1])[2])
    media = webp.store(payload)
    assert webp.load(media).tobytes() == payload and len(media) < 0.6 * len(payload)
    green = codes[-5].lengths
    assert len(set(green.values())) > 2
    assert any(256 <= s < 280 for s in green) and any(s >= 280 for s in green) and sizes[-5] > 280


def test_damaged_files_raise():
    media = webp.store(webp.padded(b"some text, some more text; " * 40))
    short = media[:16] + (len(media) - 40).to_bytes(4, "little") + media[20:-20]
    with pytest.raises(ValueError):
        webp.load(short)
