"""The scan for repeated strings holds a shard's runs, not arrays as long as its text."""

import random
import tracemalloc

import numpy as np

from arbitra.llm import substrings


def test_runs_of_a_shard_need_little_memory():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 4096, dtype=np.uint8).tobytes() for _ in range(substrings.SHARD_BYTES // 4096)]
    tracemalloc.start()
    try:
        names, text, _, lengths = substrings.runs(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert lengths.sum() == len(texts) * (4096 - substrings.LENGTH + 1) and text.max() == len(texts) - 1
    assert peak < 16 * substrings.SHARD_BYTES  # 18 MB here, 172 MB with the whole shard at once


def test_runs_do_not_depend_on_the_pieces(monkeypatch):
    rng = random.Random(3)
    for _ in range(100):
        texts = [bytes(rng.choices(b"abcd", k=rng.choice([0, 10, 49, 50, 51, 120, 700]))) for _ in range(rng.randint(0, 12))]
        monkeypatch.setattr(substrings, "PIECE_BYTES", 1 << 30)
        whole = substrings.runs(texts)
        monkeypatch.setattr(substrings, "PIECE_BYTES", 300)
        assert all(np.array_equal(a, b) for a, b in zip(whole, substrings.runs(texts)))
