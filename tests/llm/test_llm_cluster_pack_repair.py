"""Centroid clustering, packing and conversation repair against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arbitra.llm import centroids, packing, repair
from arbitra.llm.centroids import clusters, with_inertia
from arbitra.llm.packing import piece_lengths, pieces, sequences, write_buckets
from arbitra.llm.repair import Audits, digests, in_order
from arbitra.llm.repair import repair as repaired_of
from arbitra.llm.repair_query import damaged, with_digests

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# Centroid clustering


def lloyd(rows, k, rounds, dims, scale, seed):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        near = assigned()
        for n in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == n]
            if own:
                cents[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assigned())), key=str), cents


@pytest.mark.parametrize("n,k", [(300, 7), (3, 5), (40, 1)])
def test_clusters_match_plain_rounds(spark, n, k):
    rng = random.Random(n)
    rows = [(i if i % 11 else None, [rng.choice([0.0, 0.25, -0.5, rng.random() - 0.5]) for _ in range(4)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n, rows[0][1]), (n + 1, None), (n + 2, [0.0] * 3), (n + 3, [0.0, None, 0.0, 0.0]), (n + 4, [0.0, float("nan"), 0.0, 0.0]), (n + 5, [float("inf"), 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    found, cents = clusters(frame, k, 4, 4, 256, 2)
    got = sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str)
    want, plain = lloyd(rows, k, 4, 4, 256, 2)
    assert got == want and cents.tolist() == plain
    total = with_inertia(found, cents).collect()
    assert {r.inertia for r in total} == {sum(d for _, _, d in want)}
    assert all(r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) for r in total)


def test_clusters_of_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, cents = clusters(empty, 3, 2, 4)
    assert found.collect() == [] and len(cents) == 0 and found.columns == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="beyond"):
        clusters(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<float>"), 1, 1, 4)


def test_bounds_never_exceed_distances_and_prune():
    rng = np.random.default_rng(5)
    centers = rng.integers(-400, 400, (12, 16))
    points = (centers[rng.integers(0, 12, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(np.int64)
    cents = centers + rng.integers(-9, 9, centers.shape)
    pivots = centroids.far_apart(centers, 12)
    to_pivots = centroids.distances(points, pivots).astype(np.float32).astype(float)
    low = centroids.ptolemaic_bounds(to_pivots, centroids.distances(cents, pivots), centroids.distances(pivots, pivots))
    exact = ((points[:, None] - cents) ** 2).sum(2)
    assert (low <= exact).all()
    label, best, checked = centroids.nearest(points, to_pivots, cents, pivots)
    assert (label == exact.argmin(1)).all() and (best == exact.min(1)).all() and checked < 2 * len(points)


# Packing


def test_pieces_are_the_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    alphabet = "aZbéÉßÿÀ'’.,!*#%& \t\n\x0b\x1c\x85́İıſK1²½日ำªµº×÷<|endoftext|>"
    texts = [None, "", " \n", "the " * 40, "x" * 3000, "<|endoftext|> a<|startoftext|>b", "I'LL don't"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    rows = [(i, t, "src", 5) for i, t in enumerate(texts)] + [(None, "the end.", "s", 1), (3, "the " * 40, "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, length long")
    cut = pieces(frame, VOCABULARY, max_tokens=16)
    got = sequences(cut).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t, *_ in rows:
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for n in piece_lengths(len(ids), 16):
            want.append((i, at, n, ids[at : at + n].tobytes(), len(ids)))
            at += n
        assert at == len(ids)
    assert sorted(((r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.sequence_id for r in got) == list(range(len(want))) and {r.offset for r in got} == {0}
    by_number = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number, reverse=True)
    write_buckets(sequences(cut), f"{tmp_path}/buckets")
    assert spark.read.parquet(f"{tmp_path}/buckets/length=16").count() == by_number.count(16)


def test_packing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sequences(pieces(none, VOCABULARY)).collect() == []
    assert piece_lengths(0, 8) == [] and piece_lengths(29, 8) == [8, 8, 8, 4, 1]
    with pytest.raises(ValueError):
        pieces(none, VOCABULARY, max_tokens=48)


def test_long_texts_go_slice_by_slice(monkeypatch):
    words = packing.Words(VOCABULARY)
    text = ("some words, a " + "long" * 30 + "\tand\nmore é ") * 50
    whole = words.ids(text.encode().split())
    monkeypatch.setattr(packing, "SLICE", 37)
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    assert b"".join(packing.slices(text.encode())) == text.encode()
    fresh = packing.Words(VOCABULARY)
    assert fresh.text_ids(text.encode()) == whole
    assert np.frombuffer(whole, "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids


# Conversation repair


def first_fault(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.strip(" \t\n\v\f\r")[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit) by plain strings over all states."""
    kinds, moves = first_fault(rows), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                for i in "ua":
                    if (q, i) in moves:
                        best[moves[q, i]] = min(best.get(moves[q, i], (9**9, "")), (c + 5, a + "I"))
        return best

    best = inserted(best)
    for (role, _), kind in zip(rows, kinds):
        after = {}
        for q, (c, a) in best.items():
            offers = [(q, c + 2, "D")]
            if kind not in ("blank", "duplicate"):
                more = 5 if kind else 0
                offers += [(moves[q, role[:1]], c + more, "K")] if (q, role[:1]) in moves else []
                offers += [(moves[q, i], c + 1 + more, "R") for i in "ua" if (q, i) in moves]
            for s, cost, letter in offers:
                after[s] = min(after.get(s, (9**9, "")), (cost, a + letter))
        best = inserted(after)
    return min(best[q] for q in (0, 3) if q in best)


def plain_report(rows):
    """rows: (turn, role, text) of one conversation, nulls replaced."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    said = [(r, t) for _, r, t in rows]
    kinds, turns = first_fault(said), [t for t, *_ in rows if t is not None]
    cost, audit = cheapest(said)
    lines, n, k = [], 0, 0
    total = sum(x != "D" for x in audit)
    for x in audit:
        role, text = said[n] if x != "I" else ("", "")
        n += x != "I"
        if x != "D":
            lines.append(f"{role if x == 'K' else 'user' if (k - total % 2) % 2 == 0 else 'assistant'}:{text}")
            k += 1
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def talk(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "No!", "well", "", " \n", "Is it so? ", None, "a", "b.", "c."]
    return [(rng.choice([*range(n), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for _ in range(n)]


def reports_of(spark, talks):
    rows = [(c, t, r, x, "own") for c, said in talks.items() for t, r, x in said]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")
    report, repaired = repaired_of(frame)
    return {r[0]: tuple(r)[1:] for r in with_digests(frame, report, repaired).collect()}


@pytest.mark.parametrize("block,fan", [(2048, 64), (3, 2)])
def test_repair_matches_plain_strings(spark, monkeypatch, block, fan):
    """With small blocks every conversation is joined from many parts."""
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rng = random.Random(block)
    talks = {c: talk(rng, rng.randint(1, 14)) for c in range(40)} | {None: talk(rng, 30), 99: talk(rng, 70)}
    got = reports_of(spark, talks)
    for c, said in talks.items():
        assert got[c] == plain_report([(t, " " if r is None else r, " " if x is None else x) for t, r, x in said]), c


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = repaired_of(empty)
    assert report.collect() == [] and repaired.collect() == []
    gone = spark.createDataFrame([(7, 0, "user", "")], empty.schema)
    report, repaired = repaired_of(gone.where("false"))
    assert [tuple(r) for r in with_digests(gone, report, repaired).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    rows = [(c, t, None if c == 1 else "assistant", None if t == 3 else "One. Two!") for c in (1, 2, None) for t in (*range(30), None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else text.replace(".", "").replace("!", "") if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted((tuple(r) for r in damaged(frame).collect()), key=str) == sorted(want, key=str)


def test_audits_order_as_strings():
    rng = random.Random(4)
    audits, nodes = Audits(), [0]
    for _ in range(300):
        nodes.append(audits.add(rng.choice(nodes[-40:]), rng.choice("DK")))
    for a, b in itertools.islice(itertools.product(nodes[::3], repeat=2), 4000):
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))
    audits.hash = [0] * len(audits.hash)  # every hash collides
    for a, b in itertools.islice(itertools.product(nodes[::7], repeat=2), 2000):
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_order_and_digest_of_rows(spark):
    frame = spark.createDataFrame([(1, 2, "user", "b"), (1, None, "user", "a"), (None, 1, "user", "c")], "conv_id long, turn long, role string, text string")
    assert [(r.conv, r.text) for r in in_order(frame).orderBy("g").collect()] == [(None, "c"), (1, "a"), (1, "b")]
    placed = spark.createDataFrame([(None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, "user", "")], "conv long, place long, role string, text string")
    assert {r.conv: r.digest for r in digests(placed).collect()} == {
        None: hashlib.sha256(b"user:x\nassistant:y").hexdigest(), 4: hashlib.sha256(b"user:").hexdigest()
    }
