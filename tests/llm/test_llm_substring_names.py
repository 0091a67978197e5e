"""The search for repeated strings meets few strings that do not repeat, and misses none that does."""

import random

import numpy as np
import pytest
from arbitra.llm import substrings


def test_rows_that_share_shorter_strings_only_are_not_searched(spark):
    rng = random.Random(11)
    short = [bytes(rng.choices(b"abcdefgh", k=24)) for _ in range(5)]  # more than a seed, less than a window
    texts = [b"".join(rng.choice(short) + bytes(rng.choices(b"abcdefgh", k=26)) for _ in range(40)) for _ in range(30)]
    passage = bytes(rng.choices(b"abcdefgh", k=60))
    texts += [texts[0] + passage, passage + texts[1][7:]]
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts[:30])], "row long, text binary")
    assert substrings.repeated_names(rows).count() == 0
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts[1:])], "row long, text binary")
    assert {r["row"] for r in substrings.repeated_names(rows).collect()} == {0, 29, 30}


@pytest.mark.parametrize("piece", [300, 1 << 18])
def test_windows_that_repeat_have_shared_names(piece, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE_BYTES", piece)
    rng = random.Random(12)
    for _ in range(60):
        passages = [bytes(rng.choices(b"abcd", k=rng.randint(50, 90))) for _ in range(3)] + [b"a" * 80, b"ab" * 45, bytes(rng.choices(b"ab", k=17)) * 5]
        texts = [
            b"".join(rng.choice([rng.choice(passages)[rng.randint(0, 20) :], bytes(rng.choices(b"abcd", k=rng.randint(0, 60)))]) for _ in range(rng.randint(0, 5)))
            for _ in range(rng.randint(1, 12))
        ]
        name, text, start, length = substrings.runs(texts)
        hit = substrings.shared(name, text)
        covered = {(t, s + i) for t, s, n in zip(text[hit].tolist(), start[hit].tolist(), length[hit].tolist()) for i in range(n)}
        places = {}
        for t, x in enumerate(texts):
            for p in range(len(x) - substrings.LENGTH + 1):
                places.setdefault(x[p : p + substrings.LENGTH], []).append((t, p))
        assert length.sum() == sum(map(len, places.values()))
        for where in places.values():
            if len({t for t, _ in where}) > 1:
                assert covered.issuperset(where)


@pytest.mark.parametrize("length", [1, 3, 5, 7, 10])
def test_repeats_of_any_length(length):
    rng = np.random.default_rng(length)
    strings = [bytes(rng.integers(97, 100, rng.integers(0, 60)).astype(np.uint8)) for _ in range(30)]
    owners = rng.integers(0, 12, 30)
    least = {}
    for s, o in zip(strings, owners):
        for p in range(len(s) - length + 1):
            least[s[p : p + length]] = min(o, least.get(s[p : p + length], o))
    for s, o, mask in zip(strings, owners, substrings.repeats(strings, owners, length)):
        assert mask.tolist() == [bool(least[s[p : p + length]] < o) for p in range(len(s) - length + 1)]


def test_many_chunks_in_a_task(spark):
    """More than a megabyte of runs meets in few tasks; long passages are cut from all but their first document."""
    rng = random.Random(13)
    passages = ["".join(rng.choices("abcdefgh ", k=30_000)) for _ in range(30)]
    docs = spark.createDataFrame([(p * 10 + i, passages[p][i * 3 : 30_000 - i] + "é" * i) for p in range(30) for i in range(4)], "doc_id long, text string")
    out = substrings.without_repeats(substrings.written(docs)).collect()
    assert len(out) == 120
    for r in out:
        i = r["doc_id"] % 10
        assert r["n_removed"] == (30_000 - 4 * i if i else 0) and r["n_spans"] == (i > 0)
