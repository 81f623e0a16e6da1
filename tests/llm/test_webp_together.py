"""Images written together: the same files as one by one, whatever lies beside them."""

import numpy as np
import pytest

from rollcall.llm import webp

DATA = "/root/testdata/sf0.001"


def awkward():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), np.uint8)) for _ in range(300)]
    out = [b"", b"x", b" " * 5000, b"ab" * 9000, bytes(range(256)) * 60, "日本語 é ".encode() * 300]
    out += [b" ".join(words[int(k)] for k in rng.zipf(1.3, n) % 300) for n in (40, 400, 9000, 5)]
    out += [rng.integers(0, 256, 30_000, np.uint8).tobytes(), rng.integers(0, 60, 5_000, np.uint8).tobytes()]
    red = rng.integers(0, 32, (4096, 3), np.uint8)  # 64 codes of one length: a run that has no number
    red[:, 0] = rng.permutation(np.repeat(np.arange(32, 96), 64))
    skewed = b"".join(bytes([65 + k]) * (2**k) for k in range(13))  # codes that have to be cut to their limit
    return [webp.padded(t) for t in [*out, red.tobytes(), skewed, bytes(rng.permutation(list(skewed)))]]


def test_images_together_are_those_one_by_one(spark, monkeypatch):
    payloads = awkward() + [webp.padded((r.text or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()]
    want = [webp.store(p) for p in payloads]
    alone, bodies, own, together = [], [], webp.encode_rgb, webp._plain_bodies
    monkeypatch.setattr(webp, "encode_rgb", lambda *a: (alone.append(1), own(*a))[1])
    monkeypatch.setattr(webp, "_plain_bodies", lambda *a: (bodies.extend(together(*a)), bodies[-len(a[1]) :])[1])
    assert webp.store_many(payloads) == want
    assert len(bodies) > 3 * len(alone) > 0 and None in bodies
    monkeypatch.setattr(webp, "TOGETHER", 3)
    assert webp.store_many(payloads[::-1]) == want[::-1] and webp.store_many([]) == []
    assert [p.tobytes() for p in webp.load_many(want)] == payloads


def test_lengths_of_many_codes():
    rng = np.random.default_rng(6)
    counts = np.zeros((90, 300), np.int64)
    for k in range(2, 90):
        counts[k, rng.choice(300, k, replace=False)] = rng.integers(1, 50, k) if k % 2 else np.minimum(1.5 ** np.arange(k) + 1, 60_000).astype(int)
    counts[1, 7] = 5
    assert (webp._lengths_many(counts, 11) == [webp._lengths(c, 11) for c in counts]).all()


def test_lists_of_empty_texts_end():
    sizes = [len(x) for x in webp._grouped((k, b"") for k in range(30_000))]
    assert sum(sizes) == 30_000 and max(sizes) <= webp.AT_ONCE // webp.AT_LEAST


def test_tables_without_room_are_not_made():
    with pytest.raises(webp.Crowded):
        webp._tables(np.array([[1, 1], [1, 1]], np.uint8), 3)
    cells, start, mask = webp._tables(np.array([[0, 2, 1, 2], [0, 0, 0, 0], [0, 0, 0, 3], [1, 0, 1, 0]], np.uint8), 8)
    read = [[int(cells[a + k]) for k in range(m + 1)] for a, m in zip(start, mask)]
    assert read == [[2 << 4 | 1, 1 << 4 | 2, 2 << 4 | 1, 3 << 4 | 2], [0], [3 << 4], [0 << 4 | 1, 2 << 4 | 1]]
