"""What the driver holds while it learns."""

from __future__ import annotations

import tracemalloc

import numpy as np

from folioforge.llm import quality


def test_the_sample_is_encoded_in_parts(monkeypatch):
    """On the driver the features of the sample are held once, and little besides."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 600)) for _ in range(400)]
    expected = quality.passages(texts)
    monkeypatch.setattr(quality, "EPOCHS", 0)
    seen = []
    plain = quality.passages
    monkeypatch.setattr(quality, "passages", lambda some: seen.append(len(some)) or plain(some))
    tracemalloc.start()
    quality.fit(texts, np.arange(400) % 2, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * expected[0].nbytes
    assert sum(seen) == 400
    monkeypatch.setattr(quality, "passages", plain)
    assert all(np.array_equal(a, b) for a, b in zip(quality._sample_passages([*texts[:70], "", " "]), quality.passages([*texts[:70], "", " "]), strict=True))
    assert quality._sample_passages([])[0].shape == (0, quality.WIDTH)
