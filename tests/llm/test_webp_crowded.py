"""Many small images at once: where their code tables are too large together, they go in halves, still in step."""

import pytest

from rollcall.llm import webp


def test_crowded_images_are_read_in_halves(monkeypatch):
    texts = [webp.padded((f"line {k} of some text, " * (k % 9 + 1)).encode()) for k in range(60)]
    media = [webp.store(t) for t in texts]
    monkeypatch.setattr(webp, "LOCKSTEP_CELLS", 2_000)
    monkeypatch.setattr(webp, "load", lambda m: pytest.fail("an image was decoded by itself"))
    assert [p.tobytes() for p in webp.load_many(media)] == texts


def test_one_image_beyond_the_tables_is_read_by_itself(monkeypatch):
    monkeypatch.setattr(webp, "LOCKSTEP_CELLS", 1)
    texts = [webp.padded(f"text {k} of a few different words".encode()) for k in range(3)]
    assert [p.tobytes() for p in webp.load_many([webp.store(t) for t in texts])] == texts
